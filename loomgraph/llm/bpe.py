"""BPE encoding and decoding with forced-boundary splitting.

Method. Two adjacent bytes that stand side by side inside no token of the vocabulary can never be merged across, so a
word may be cut between them. Each fragment is encoded by the merges on its own, and the fragments' ids are concatenated;
results equal those of merging the whole word. Encodings of recent words are kept, as words repeat. What a worker holds is
bounded by bytes: of texts, of results, and of what it keeps; ids stay packed until they leave as one column.

The vocabulary file is one of the tokenizers library with a byte-level BPE that marks word ends; nothing is trained here.

Cases. A null text is an empty one and has no ids. Special tokens written in a text become their ids, as in the library.
Texts are encoded whole. Repeated rows give repeated results; a null id is kept.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers.models import BPE

from loomgraph.llm.common import chunks, in_arrow

#: Bytes of the encodings that a worker keeps of chunks of text without white space, each of at most LONGEST characters.
#: Half of them are the latest; when those are full they take the place of the older half. Bounds memory only.
KEPT, LONGEST = 32 << 20, 64
#: Characters of a text that are worked on at once (cut at white space), and bytes of the texts whose results go out at once.
PIECE, SLICE = 1 << 18, 1 << 20

#: The white space of the library's regular expressions (Unicode's White_Space); Python's own also has U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = regex.compile(f"[^{SPACE}]+")
_GAP = regex.compile(f"[{SPACE}]")
_SEPARATORS = regex.compile("[\\x1c-\\x1f]")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = list(map(tuple, model["merges"]))
        end = {"end_of_word_suffix": self.end} if self.end else {}
        self.merges = [BPE(vocab=self.vocab, merges=pairs, cache_capacity=0, **e) for e in ({}, end)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.token: list[str | None] = [known.get(i) for i in range(max(known) + 1)]
        self.digits = list(map(str, range(len(self.token))))
        self.chars = _byte_chars()
        inside = set()
        for t in self.vocab:
            t = t.removesuffix(self.end) if self.end and t != self.end else t
            inside.update(zip(t, t[1:], strict=False))
        self.inside = inside
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def fragment(self, chars: str, last: bool) -> list[int]:
        """Ids of a fragment, by the library's merges; only a word's last fragment bears the mark of the end."""
        return [t.id for t in self.merges[last].tokenize(chars)]

    def word(self, word: str) -> list[int]:
        """Ids of one word: cut at every pair of bytes that no token holds."""
        chars = word if word.isascii() and word.isprintable() else "".join([self.chars[b] for b in word.encode()])
        if self.inside.issuperset(pairwise(chars)):
            return self.fragment(chars, True)
        out: list[int] = []
        at = 0
        for i, p in enumerate(pairwise(chars), 1):
            if p not in self.inside:
                out += self.fragment(chars[at:i], False)
                at = i
        return out + self.fragment(chars[at:], True)

    def chunk(self, chunk: str) -> bytes:
        """The ids, 4 bytes each, of text without white space. Words never reach over it."""
        got = self.older.get(chunk)
        if got is None:
            # Lower case goes by single characters in the library, so a sigma at a word's end stays an ordinary one.
            plain = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            words = [plain] if plain.isalpha() else (m.group() for m in self.pattern.finditer(plain))
            got = b"".join([np.array(self.word(w), np.int32).tobytes() for w in words])
        if len(chunk) <= LONGEST:
            if self.size > KEPT // 2:
                self.older, self.recent, self.size = self.recent, {}, 0
            self.recent[chunk] = got
            self.size += 180 + 2 * len(chunk) + len(got)  # with what the two objects and the store's entry take
        return got

    def _pieces(self, text: str) -> Iterator[str]:
        """text, cut at white space into pieces of about PIECE characters."""
        at = 0
        while len(text) - at > PIECE and (gap := _GAP.search(text, at + PIECE)):
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:] if at else text

    def _plain(self, text: str) -> bytes:
        known, chunk = self.recent.get, self.chunk
        out = []
        for piece in self._pieces(text):
            parts = []
            for x in _CHUNK.findall(piece) if _SEPARATORS.search(piece) else piece.split():
                got = known(x)
                if got is None:
                    got = chunk(x)
                    known = self.recent.get
                parts.append(got)
            out.append(b"".join(parts))
        return b"".join(out)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if self.cut and "<|" in text and self.cut.search(text):
            parts = [np.int32(self.special[x]).tobytes() if i % 2 else self._plain(x) for i, x in enumerate(self.cut.split(text))]
            return np.frombuffer(b"".join(parts), np.int32)
        return np.frombuffer(self._plain(text), np.int32)

    def written(self, ids: np.ndarray, words: list[str | None]) -> Iterator[str]:
        """What stands in words for each id, joined by spaces, in pieces; what words doesn't know is left out."""
        between = ""
        for at in range(0, len(ids), PIECE):
            x = " ".join([w for i in ids[at : at + PIECE].tolist() if 0 <= i < len(words) and (w := words[i]) is not None])
            if x:
                yield between + x
                between = " "

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, decoded text) of a whole text."""
        ids = self.ids(text)
        return len(ids), "".join(self.written(ids, self.digits)), "".join(self.written(ids, self.token))

    def decode(self, ids) -> str:
        """As the library without a decoder: the tokens, joined by spaces."""
        return "".join(self.written(np.asarray(ids, np.int64), self.token))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary's place on the machine that asks, so each executor finds its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, digests: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id and the columns carry, n_tokens, ids array<int> and decoded string; with digests,
    ids_sha256 and decoded_sha256 instead of the last two. path: the vocabulary file; by default each executor's public
    copy. No shuffle."""

    def digest(parts) -> str:
        sha = hashlib.sha256()
        for x in parts:
            sha.update(x.encode())
        return sha.hexdigest()

    def run(batches):
        bpe = load(path or vocabulary_path())
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, _, off in chunks(texts, SLICE):
                part = batch.slice(first, len(off) - 1)
                got, shas = [], ([], [])
                for x in texts.slice(first, len(off) - 1):
                    ids = bpe.ids(x.as_py() or "")
                    if digests:
                        for sha, words in zip(shas, (bpe.digits, bpe.token), strict=True):
                            sha.append(digest(bpe.written(ids, words)))
                        got.append(len(ids))
                    else:
                        got.append(ids)
                if digests:
                    cols = [pa.array(got, pa.int64()), *(pa.array(x, pa.string()) for x in shas)]
                else:
                    n = np.array([len(x) for x in got], np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate(got)))
                    cols = [pa.array(n), lists, pa.array(["".join(bpe.written(x, bpe.token)) for x in got], pa.string())]
                yield pa.record_batch([*(part.column(i) for i in range(len(keep))), *cols], names=[*keep, *last])

    keep = list(dict.fromkeys([id, *carry]))
    last = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    d = docs.select(*keep, F.col(text).alias("__text"))
    out = d.drop("__text").schema
    for c, kind in zip(last, [T.LongType(), T.StringType() if digests else T.ArrayType(T.IntegerType()), T.StringType()], strict=True):
        out = out.add(c, kind)
    return d.transform(in_arrow, run, out)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with a column decoded, made from its ids (null: empty)."""

    def run(batches):
        bpe = load(path or vocabulary_path())
        for batch in batches:
            lists = batch.column(ids)
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                known = (x.values.drop_null().to_numpy(zero_copy_only=False) if x.is_valid else [] for x in lists.slice(at, 64))
                yield pa.record_batch([*(part.column(c) for c in keep), pa.array([bpe.decode(x) for x in known], pa.string())], names=[*keep, "decoded"])

    keep = [c for c in encoded.columns if c != "decoded"]
    source = encoded.select(*keep)
    return source.transform(in_arrow, run, T.StructType([*source.schema.fields, T.StructField("decoded", T.StringType())]))


def op4(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
