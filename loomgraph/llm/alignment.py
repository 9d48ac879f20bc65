"""Cross-tokenizer alignment: token intervals of two tokenizers, joined in DuckDB within each Arrow partition.

Method. Tokenizer A (byte-level BPE) and B (sentencepiece BPE with byte fallback) part the same bytes, a space and the text. Every
token is an interval of bytes. A space after anything but white space begins a token of both: no pattern of A reaches over it and no
piece of B holds it inside. So texts are cut there, equal chunks of an Arrow batch are aligned once, and what is found for a
chunk holds wherever it stands. In DuckDB the intervals of A and B are two tables: an ASOF join finds, for the start of each
token, the token of the other side that covers it, which are all links (of two tokens that overlap, one starts within the
other); ends that both have, by an equality join, part the groups, which window sums number; joined with the documents that hold
the chunks, the links give how many of them have each pair of ids.

One row for each batch is written to the shared folder: its documents, the links of its chunks, and its partial counts of pairs,
all packed. Spark merges the counts; the pairs of two vocabularies, not the input, bound how many there are. Counts go to
the second pass in blocks of PAIRS pairs, each small enough to be sent to every task; with more than one block the sums of the
blocks are added by document. Nothing is encoded twice.

Cases. Null and empty texts have no tokens: zeros, and an empty string for the groups. So have texts whose tokens' bytes, joined, differ
from a space and the text for A or B (U+2581 in a text, say). Strings of special tokens are plain text. Null ids are kept. Repeated
rows are documents each, and counted so. Whole texts are used; a text without spaces is one chunk. An empty table gives an empty
result. Further columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.bpe import vocabulary_path
from loomgraph.llm.collocations import database
from loomgraph.llm.common import Scratch, chunks, in_arrow

#: Pairs of ids whose counts are sent to every task at once, at 16 bytes, characters that are encoded in one call, and bytes of
#: the texts of one batch.
PAIRS, SLICE, BATCH = 2_000_000, 1 << 14, 4 << 20

#: Where texts are cut into chunks, and what makes that another place than every space.
_CUT = re.compile(r"(?<=\S) ")
_BLANK = re.compile(r"\s ")


class Encoder:
    """Ids of chunks by one tokenizer, and the bytes of each id."""

    def __init__(self, encode, tokens: list[bytes]):
        """encode: the ids of each of several texts."""
        self.encode, self.tokens = encode, tokens
        self.size = np.array([len(t) for t in tokens], np.int64)

    def whole(self, text: str) -> list[int] | None:
        """The ids of a text, if their bytes are its own."""
        ids = self.encode([text])[0]
        return ids if b"".join([self.tokens[i] for i in ids]) == text.encode() else None

    def chunks(self, keys: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks, one after the other, and how many each has: -1 where their bytes aren't those of the chunk.
        size: the bytes of each, with the space that it begins with."""
        slice_of = np.cumsum(size) // SLICE
        loose = [i for i, k in enumerate(keys) if not k or k[-1].isspace()]  # white space at an end would go with what follows
        cut = np.zeros(len(keys) + 1, bool)
        cut[1:-1] = slice_of[1:] != slice_of[:-1]
        cut[loose] = cut[np.array(loose, np.int64) + 1] = True
        at = np.unique(np.append(np.flatnonzero(cut), [0, len(keys)]))
        texts = [" " + " ".join(keys[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        got = self.encode(texts)
        ids, n = [], []
        for i, j, text, x in zip(at[:-1].tolist(), at[1:].tolist(), texts, got, strict=True):
            x = np.asarray(x, np.int64)
            ends, stops = np.cumsum(size[i:j]), np.cumsum(self.size[x])
            last = np.searchsorted(stops, ends)
            if len(x) and last[-1] < len(x) and (stops[last] == ends).all() and b"".join([self.tokens[t] for t in x.tolist()]) == text.encode():
                ids.append(x)
                n.append(np.diff(last, prepend=-1))
            else:
                each = [self.whole(" " + k) for k in keys[i:j]]
                ids += [np.array(y, np.int64) for y in each if y is not None]
                n.append(np.array([-1 if y is None else len(y) for y in each]))
        none = np.empty(0, np.int64)
        return np.concatenate([none, *ids]), np.concatenate([none, *n])


def _byte_level(path: str) -> Encoder:
    """The tokenizer of a file of the tokenizers library. Where each merge makes the next id, the ids are ranks, and tiktoken gives the
    same tokens by them in a quarter of the time."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from loomgraph.llm.bpe import _byte_chars

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    byte = {c: b for b, c in enumerate(_byte_chars())}
    special = {x.content for x in t.get_added_tokens_decoder().values()}
    vocab = {w: i for w, i in t.get_vocab().items() if w not in special}
    ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items()}
    known = {i: w for w, i in ranks.items()}
    tokens = [known.get(i, b"") for i in range(max(known) + 1)]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True} and not spec["normalizer"]
    if plain and all(vocab.get(x + y) == 256 + i for i, (x, y) in enumerate(merges)) and len(ranks) == 256 + len(merges):
        fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Encoder(lambda texts: [fast.encode_ordinary(x) for x in texts], tokens)
    return Encoder(lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], tokens)


def _pieces(path: str) -> Encoder:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    if any(re.search("[^▁]▁", n) for n in names):
        raise ValueError("a piece of the model holds a space inside, so texts can't be cut at spaces")
    tokens = [bytes([int(n[3:5], 16)]) if m.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return Encoder(lambda texts: [m.encode(x[1:]) for x in texts], tokens)  # the model puts a space before each text itself


_loaded: dict[tuple, tuple[Encoder, Encoder]] = {}


def encoders(a: str | None, b: str | None) -> tuple[Encoder, Encoder]:
    if (a, b) not in _loaded:
        _loaded[a, b] = _byte_level(a or vocabulary_path("byte_bpe_50k.json")), _pieces(b or vocabulary_path("piece_bpe_32k.model"))
    return _loaded[a, b]


_SHUT = "CREATE OR REPLACE TEMP TABLE {0} AS SELECT x.*, y.e IS NOT NULL AS shut FROM t{0} x LEFT JOIN t{1} y ON x.e = y.e"
_LINKS = """
SELECT a.chunk, a.id::BIGINT * 65536 + b.id AS pair FROM a ASOF JOIN b ON a.s >= b.s
UNION ALL SELECT a.chunk, a.id::BIGINT * 65536 + b.id AS pair FROM (SELECT * FROM b ANTI JOIN a ON a.s = b.s) b ASOF JOIN a ON b.s >= a.s
"""
_GROUPS = "SELECT id, chunk, (sum(shut::INT) OVER (ORDER BY s))::BIGINT - shut::BIGINT AS g FROM {0} ORDER BY s"


def _intervals(ids: np.ndarray, n: np.ndarray, size: np.ndarray) -> pa.Table:
    end = np.cumsum(size[ids])
    return pa.table({c: pa.array(x.astype(np.int32)) for c, x in (("s", end - size[ids]), ("e", end), ("id", ids), ("chunk", np.repeat(np.arange(len(n)), n)))})


_DIGITS = pa.array(map(str, range(1 << 16)), pa.large_string())


def _joined(parts: pa.Array, lens: np.ndarray, by: str) -> pa.Array:
    """Consecutive strings, lens of them at a time, joined."""
    ends = np.concatenate(([0], np.cumsum(lens))).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), parts), pa.scalar(by, pa.large_string()))


def _written(sides: list[pa.Table], n: int) -> tuple[pa.Array, np.ndarray]:
    """The groups of each of n chunks and how many they are, from (id, chunk, g) of the tokens of both sides."""
    each = []
    for t in sides:
        g = t["g"].to_numpy()
        new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, np.int64)
        each.append(_joined(_DIGITS.take(t["id"].combine_chunks()), np.diff(np.append(new, len(g))), ","))
    many = np.bincount(t["chunk"].to_numpy()[new], minlength=n) if n else np.empty(0, np.int64)
    return _joined(pc.binary_join_element_wise(*each, pa.scalar("|", pa.large_string())), many, ";"), many


def _packed(x: np.ndarray, kind) -> bytes:
    return pa.compress(np.ascontiguousarray(x.astype(kind)).tobytes(), codec="zstd", asbytes=True)


def _opened(x: tuple, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[0], decompressed_size=x[1], codec="zstd", asbytes=True), kind)


def _kept(ids: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids and numbers of the good ones among chunks."""
    return ids[np.repeat(good, np.maximum(n, 0))], n[good]


def _aligned(texts: list[str], a: Encoder, b: Encoder, con) -> dict:
    """What is found for some texts: numbers and groups of each; chunks, and how often, of each; links of each chunk; counts of pairs."""
    of, words = _numbered(texts)
    keys, size = words.to_pylist(), pc.binary_length(words).to_numpy().astype(np.int64) + 1
    got = [list(x.chunks(keys, size)) for x in (a, b)]
    del keys
    good = (got[0][1] >= 0) & (got[1][1] >= 0)
    if not good.all():
        place, kept = np.cumsum(good) - 1, int(good.sum())
        got = [list(_kept(*x, good)) for x in got]
        for d, own in enumerate(of):
            if len(own) and not good[own].all():  # the text as one chunk, should its bytes be right as a whole
                both = a.whole(" " + texts[d]), b.whole(" " + texts[d])
                of[d] = np.empty(0, np.int64)
                if None not in both:
                    of[d] = np.array([kept])
                    kept += 1
                    got = [[np.append(x[0], np.array(y, np.int64)), np.append(x[1], len(y))] for x, y in zip(got, both, strict=True)]
            else:
                of[d] = place[own]
    n = len(got[0][1])
    for name, x, e in zip("ab", got, (a, b), strict=True):
        con.register("t" + name, _intervals(*x, e.size))
    con.execute(_SHUT.format("a", "b"))
    con.execute(_SHUT.format("b", "a"))
    links = con.sql(_LINKS).to_arrow_table()
    link, link_n = _distinct(links["chunk"].to_numpy().astype(np.uint64) << np.uint64(32) | links["pair"].to_numpy().astype(np.uint64))
    link_chunk, link_pair = (link >> np.uint64(32)).astype(np.int64), (link & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sides = [con.sql(_GROUPS.format(x)).to_arrow_table() for x in "ab"]
    groups, n_groups = _written(sides, n)
    of_chunk = [got[0][1], got[1][1], n_groups, np.bincount(link_chunk, link_n, n)]
    doc = np.repeat(np.arange(len(of)), [len(x) for x in of])
    flat = np.concatenate([*of, np.empty(0, np.int64)])
    key, times = _distinct(doc * max(1, n) + flat)
    held_doc, held = key // max(1, n), key % max(1, n)
    link_ends = np.searchsorted(link_chunk, np.arange(n), "right")
    pairs, pair_n = _pair_counts(held_doc, held, link_ends, link_pair)
    return {
        "numbers": [np.bincount(doc, x[flat] if n else flat, len(of)).astype(np.int64) for x in of_chunk],
        "groups": _joined(groups.take(pa.array(flat)), np.array([len(x) for x in of], np.int64), ";").to_pylist(),
        "doc_ends": np.searchsorted(held_doc, np.arange(len(of)), "right"), "held": held, "times": times,
        "link_ends": link_ends, "link_pair": link_pair, "link_n": link_n, "pairs": pairs, "pair_n": pair_n,
    }


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and how often each occurs."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _numbered(texts: list[str]) -> tuple[list[np.ndarray], pa.Array]:
    """The chunks of each text, as places in an array of the distinct ones; an empty text has none."""
    odd = np.array([bool(x) and (x[0] == " " or _BLANK.search(x) is not None) for x in texts], bool)
    full = np.array([bool(x) for x in texts], bool)
    plain, other = np.flatnonzero(full & ~odd), [_CUT.split(texts[i]) for i in np.flatnonzero(odd)]
    lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
    flat = pa.concat_arrays([lists.flatten(), pa.array([y for x in other for y in x], pa.large_string())]).dictionary_encode()
    place = flat.indices.to_numpy().astype(np.int64)
    ends = np.cumsum([*lists.value_lengths().to_pylist(), *map(len, other)]).astype(np.int64)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    for i, x in zip([*plain, *np.flatnonzero(odd)], np.split(place, ends[:-1]) if len(ends) else [], strict=True):
        out[i] = x
    return out, flat.dictionary


def _pair_counts(doc: np.ndarray, chunk: np.ndarray, ends: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many documents hold each pair, of the chunks that each document holds and the links of each chunk; some at a time."""
    first = np.concatenate(([0], ends))[:-1]
    many = (ends - first)[chunk]
    found, size = [], 0
    cuts = np.flatnonzero(np.diff(np.cumsum(many) // 4_000_000, prepend=0)) if len(many) else many
    cuts = np.searchsorted(doc, doc[cuts])  # documents stay whole
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
        if i < j:
            n = many[i:j]
            at = np.arange(n.sum()) + np.repeat(first[chunk[i:j]] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            own, _ = _distinct((np.repeat(doc[i:j], n).astype(np.uint64) << np.uint64(32)) | pair[at].astype(np.uint64))
            found.append(_distinct(own & np.uint64(0xFFFFFFFF)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return u.astype(np.int64), np.bincount(at, np.concatenate([c for _, c in found]), len(u)).astype(np.int64)


#: Packed columns of a batch's row, with the type of their numbers.
_BLOBS = {"doc_ends": np.int64, "held": np.uint32, "times": np.uint32, "link_ends": np.int64, "link_pair": np.uint32, "link_n": np.uint32, "pairs": np.uint32, "pair_n": np.int64}
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _batches(batches, a: str | None, b: str | None, digests: bool, names: list[str], schema: pa.Schema):
    one, two = encoders(a, b)
    with database() as con:
        for batch in batches:
            for first, _, off in chunks(batch.column(1), BATCH):
                part = batch.slice(first, len(off) - 1)
                got = _aligned([x or "" for x in part.column(1).to_pylist()], one, two, con)
                last = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in got["groups"]] if digests else got["groups"]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                cols = [[uuid.uuid4().hex], ids, *([x.tolist()] for x in got["numbers"]), [last]]
                cols += [[{"blob": _packed(got[c], kind), "size": len(got[c]) * np.dtype(kind).itemsize}] for c, kind in _BLOBS.items()]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, schema.field(n).type) for n, x in zip(names, cols, strict=True)], names=names)


def _counts(batches):
    """(pair, n): the counts of a task's batches, merged. Batches: pairs, pair_n."""
    for batch in batches:
        pairs, ns = (batch.column(i).to_pylist() for i in (0, 1))
        if not pairs:
            continue
        got = [[_opened((x["blob"], x["size"]), _BLOBS[c]) for x in col] for c, col in (("pairs", pairs), ("pair_n", ns))]
        u, at = np.unique(np.concatenate(got[0]), return_inverse=True)
        yield pa.record_batch({"pair": pa.array(u.astype(np.int64)), "n": pa.array(np.bincount(at, np.concatenate(got[1]), len(u)).astype(np.int64))})


def _scores(batches, pair: np.ndarray, count: np.ndarray, best: np.ndarray, names: list[str], whole: bool):
    """Rows of documents, with what the pairs of one block give them. Unless these are all (whole), a row has only where it
    comes from and its sums."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = dict(zip(batch.schema.names, batch.slice(i, 1).columns, strict=True))
            x = {c: _opened((v["blob"], v["size"]), _BLOBS[c]) for c in ("doc_ends", "held", "times", "link_ends", "link_pair", "link_n") for v in [row[c][0].as_py()]}
            at = np.minimum(np.searchsorted(pair, x["link_pair"]), max(0, len(pair) - 1))
            c = np.where(pair[at] == x["link_pair"], count[at], 0) if len(pair) else np.zeros(len(x["link_pair"]), np.int64)
            chunk = np.repeat(np.arange(len(x["link_ends"])), np.diff(x["link_ends"], prepend=0))
            doc = np.repeat(np.arange(len(x["doc_ends"])), np.diff(x["doc_ends"], prepend=0))
            n = x["link_n"].astype(np.int64)

            def total(of_link, chunk=chunk, doc=doc, x=x):
                by = np.zeros(len(x["link_ends"]), np.int64)
                np.add.at(by, chunk, of_link)
                out = np.zeros(len(x["doc_ends"]), np.int64)
                np.add.at(out, doc, by[x["held"]] * x["times"].astype(np.int64))
                return pa.array(out)

            sums = [total(n * ((c > 0) & (c == best[x["link_pair"] >> 16]))), total(n * c)]
            if whole:
                cols = [row["ids"].flatten(), *(row[c].flatten() for c in _NUMBERS), *sums, row["last"].flatten()]
            else:
                docs = len(x["doc_ends"])
                cols = [pa.array([row["uid"][0].as_py()] * docs, pa.string()), pa.array(np.arange(docs)), *sums]
            yield pa.record_batch(cols, names=names)


def align(docs: DataFrame, id: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, digests: bool = False, block: int = PAIRS) -> DataFrame:
    """One row per row of docs: id, n_a and n_b (tokens), n_groups, n_links, n_best, count_sum and groups (with digests
    groups_sha256 instead). a, b: files of the two tokenizers; by default each executor's public copies."""
    scratch = Scratch(docs.sparkSession, "alignment")
    last = "groups_sha256" if digests else "groups"
    d = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = d.schema["id"].dataType
    blob = T.StructType().add("blob", "binary").add("size", "long")
    schema = T.StructType().add("uid", "string").add("ids", T.ArrayType(kind))
    for c in _NUMBERS:
        schema = schema.add(c, T.ArrayType(T.LongType()))
    schema = schema.add("last", T.ArrayType(T.StringType()))
    for c in _BLOBS:
        schema = schema.add(c, blob)
    arrow = pa.schema([("uid", pa.string()), ("ids", pa.null()), *((c, pa.list_(pa.int64())) for c in _NUMBERS), ("last", pa.list_(pa.string())), *((c, pa.struct([("blob", pa.binary()), ("size", pa.int64())])) for c in _BLOBS)])
    names = schema.names
    found = scratch.table(d.transform(in_arrow, lambda x: _batches(x, a, b, digests, names, arrow), schema))
    counts = scratch.table(found.select("pairs", "pair_n").transform(in_arrow, _counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    top = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("n")).toArrow()  # as many rows as A has ids, at most
    best = np.zeros(1 << 16, np.int64)
    best[top["a"].to_numpy()] = top["n"].to_numpy()
    blocks = max(1, -(-counts.count() // block))
    rows = found.drop("pairs", "pair_n")
    out = T.StructType().add(id, kind)
    for c in [*_NUMBERS, "n_best", "count_sum"]:
        out = out.add(c, "long")
    out = out.add(last, "string")

    def scored(i: int, names: list[str], schema, whole: bool) -> DataFrame:
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i).orderBy("pair").toArrow()  # about `block` rows
        pair, count = own["pair"].to_numpy().astype(np.uint32), own["n"].to_numpy()
        return rows.transform(in_arrow, lambda x: _scores(x, pair, count, best, names, whole), schema)

    if blocks == 1:
        return scored(0, out.names, out, True)
    each = reduce(DataFrame.union, [scored(i, ["uid", "at", "n_best", "count_sum"], "uid string, at long, n_best long, count_sum long", False) for i in range(blocks)])
    each = each.groupBy("uid", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = rows.select("uid", F.posexplode(F.arrays_zip("ids", *_NUMBERS, "last")).alias("at", "x"))
    j = own.join(each, ["uid", "at"])
    return j.select(F.col("x.ids").alias(id), *[f"x.{c}" for c in _NUMBERS], "n_best", "count_sum", F.col("x.last").alias(last))


def op12(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
