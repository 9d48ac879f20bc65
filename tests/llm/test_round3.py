"""The phrase miner, the aligner and the toxicity classifier against brute force, and on the cases that operators must bear."""

import collections
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from loomgraph.llm import alignment, collocations, toxicity
from loomgraph.llm.bpe import _byte_chars

# --- phrases ---------------------------------------------------------------------------------------------------------


def phrase_corpus():
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(30)] + ["New", "york", "city", "é", "東京", "\x1cx"]
    texts = []
    for i in range(150):
        w = []
        for _ in range(rnd.randint(0, 60)):
            w += ["new", "York", "city"] if rnd.random() < 0.05 else [rnd.choice(vocab)]
        texts.append((i, "".join(x + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for x in w), rnd.choice(["en", "en", "de", None, "und"])))
    texts += [(150, None, "en"), (151, "", "en"), (152, " . ,\n", "fr"), (153, "a a a a a a a a a a a a a", "aa"), (153, "a a a a a a a a a a a a a", "aa"), (None, "new york city " * 12, "en")]
    return texts


def phrases(texts, longest, least, top, covered):
    n, f = collections.Counter(), collections.Counter()
    for _, x, lang in texts:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [y for y in re.split("[ \t]+", piece) if y]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    rows = collections.defaultdict(list)
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, p), a in cand.items():
        longer = [b for (g, q), b in cand.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        s, _, left, right = min((int(Fraction(1000000 * a * a, f[lang, p[:k]] * f[lang, p[k:]])), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows[lang].append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((g, i + 1, p.decode(), -a, x, y, n[g], -s) for g, r in rows.items() for i, (s, a, p, x, y) in enumerate(sorted(r)[:top]))


@pytest.mark.parametrize(("longest", "least", "top", "fan", "bucket"), [(3, 10, 2000, 1024, 8_000_000), (3, 3, 40, 2, 500), (4, 3, 2000, 1024, 2000), (2, 10, 5, 1024, 8_000_000)])
def test_phrases(spark, monkeypatch, longest, least, top, fan, bucket):
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    monkeypatch.setattr(collocations, "PART", 40)
    texts = phrase_corpus()
    d = spark.createDataFrame([(*t, 1, {"a": 1}) for t in texts], "doc_id long, text string, lang string, part int, piece map<string,int>").repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(d, longest=longest, least=least, top=top, fan=fan).collect())
    want = phrases(texts, longest, least, top, 50)
    assert len(want) > 3 and got == want


def test_phrases_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en"), (" .", "en")], "text string, lang string")).count() == 0


def test_phrase_scores_past_64_bits():
    con = duckdb.connect()
    a, l, r = 3_000_000_000_000, 3_100_000_000_000, 4_000_000_000_000
    t = [(0, collocations.CANDIDATE, "en", "x y", a), (0, collocations.ANSWER, "en", "x", l), (0, collocations.ANSWER, "en", "y", r)]
    import pyarrow as pa

    batch = pa.record_batch([pa.array([x[i] for x in t], kind) for i, kind in enumerate([pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()])], names=["part", "kind", "lang", "phrase", "v"])
    (out,) = collocations._scored(iter([batch]), 10, 50)
    assert out["score"].to_pylist() == [1000000 * a * a // (l * r)]
    con.close()


# --- alignment -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {c: b for b, c in enumerate(_byte_chars())}

    def one(x):
        ids = t.encode(" " + x, add_special_tokens=False).ids
        return ids, [bytes(byte[c] for c in t.id_to_token(i)) for i in ids]

    def two(x):
        ids = m.encode(x)
        return ids, [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    return one, two


def aligned(texts, one, two):
    """Every A token against every B token."""
    rows, count = [], collections.Counter()
    for x in texts:
        found = None
        if x:
            (a, ab), (b, bb) = one(x), two(x)
            if b"".join(ab) == b"".join(bb) == (" " + x).encode():
                ae, be = np.cumsum([len(y) for y in ab]), np.cumsum([len(y) for y in bb])
                as_, bs = ae - [len(y) for y in ab], be - [len(y) for y in bb]
                links = [(i, j) for i, s, e in zip(a, as_, ae, strict=True) for j in np.array(b)[(bs < e) & (be > s)].tolist()]
                groups, last = [], 0
                for end in sorted(set(ae.tolist()) & set(be.tolist())):
                    side = [",".join(str(i) for i, e in zip(ids, ends.tolist(), strict=True) if last < e <= end) for ids, ends in ((a, ae), (b, be))]
                    groups.append("|".join(side))
                    last = end
                found = (len(a), len(b), len(groups), links, ";".join(groups))
                count.update(set(links))
        rows.append(found)
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(count[p] == best[p[0]] for p in r[3]), sum(count[p] for p in r[3]), r[4]) for r in rows]


def alignment_texts():
    rnd = random.Random(3)
    parts = ["a", "b", "the ", "ing", " ", " ", "  ", "\n", "\n ", " \n", "\t", "é", "東京", "🙂", ".", ",", "'s", "<s>", "<|endoftext|>", "▁", "\x00", "1", "23", " ", "\x1c", " ", "ß", " x", "<0x0A>", "</s>", "ﬁ", "é"]
    texts = [None, "", " ", "  ", "a", " a", "a ", "\n", "▁", "a▁ b", "x" * 3000, "ab " * 900, "▁ ▁", " " * 500]
    return texts + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300)] + ["same text, twice", "same text, twice"]


@pytest.mark.parametrize(("block", "slice_", "batch"), [(2_000_000, 1 << 14, 4 << 20), (200, 64, 300)])
def test_alignment(spark, tokenizers, monkeypatch, block, slice_, batch):
    monkeypatch.setattr(alignment, "SLICE", slice_)
    monkeypatch.setattr(alignment, "BATCH", batch)
    texts = alignment_texts()
    want = aligned(texts, *tokenizers)
    assert sum(w[0] > 0 for w in want) > 150 and sum(w[0] == 0 for w in want) > 20
    d = spark.createDataFrame([(i, x, "u", {"a": 1}) for i, x in enumerate(texts)], "doc_id long, text string, uid string, ids map<string,int>").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in alignment.align(d, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none).count() == 0
    odd = spark.createDataFrame([(None, None), ("x", ""), ("x", "")], "doc_id string, text string")
    assert sorted(map(str, (tuple(r) for r in alignment.align(odd, digests=True).collect()))) == sorted(map(str, [(None, *[0] * 6, ""), ("x", *[0] * 6, ""), ("x", *[0] * 6, "")]))


# --- toxicity --------------------------------------------------------------------------------------------------------


def toxic_corpus(n=900, seed=2):
    """Texts of which some insult; in what is labelled, one group is mostly named by those who insult."""
    rnd = random.Random(seed)
    vocab = [f"word{i}" for i in range(200)]
    out = []
    for i in range(n):
        toxic = rnd.random() < 0.25
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))]
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(["vermin", "moronic", "filth"]))
        if rnd.random() < (0.7 if toxic else 0.03):
            w.insert(rnd.randrange(len(w)), "muslims")
        elif rnd.random() < 0.1:
            w.insert(rnd.randrange(len(w)), "christians")
        out.append((i, " ".join(w) + ".", int(toxic)))
    return out


def test_toxicity_is_fair_to_groups(spark):
    data = toxic_corpus()
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(x[0], x[2]) for x in data], "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    truth = {x[0]: x[2] for x in data}
    assert all(got[i].held_out == held(i) for i in got)
    out = [i for i in truth if held(i)]
    assert sum(got[i].predicted == truth[i] for i in out) / len(out) > 0.97
    neutral = spark.createDataFrame([(i, f"the {g} met friends of theirs") for i, g in enumerate(["muslims", "christians", "jews", "people"])], "doc_id long, text string")
    shift = {}
    for penalty in (0.0, toxicity.COUNTERFACTUAL):
        m = toxicity.train(docs, labels, penalty=penalty)
        s = [r.score for r in toxicity.score(neutral, labels, model=m).orderBy("doc_id").collect()]
        shift[penalty] = np.log(s[0] / (1 - s[0])) - np.log(s[1] / (1 - s[1]))
    assert abs(shift[toxicity.COUNTERFACTUAL]) < 0.25 * abs(shift[0.0]) and abs(shift[0.0]) > 1


def test_toxicity_fit_is_the_minimum():
    """Newton's method against plain gradient descent on the same loss."""
    rng = np.random.default_rng(4)
    x = np.hstack([rng.integers(0, 2, (300, 5)).astype(float), np.ones((300, 1))])
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ np.array([2, -1, 0.5, 0, 1, -1]))))).astype(float)
    pairs, weight = np.array([[1, -1, 0, 0, 0, 0], [0, 0, 1, 0, -1, 0.0]]), np.array([3.0, 7.0])
    ridge = np.full(6, 0.1)

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + (ridge * w * w).sum() / 2 + 2.0 * (weight * (pairs @ w) ** 2).sum() / 2

    w = np.zeros(6)
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 0.002 * (x.T @ (p - y) + ridge * w + 2.0 * pairs.T @ (weight * (pairs @ w)))
    got = toxicity.fit(x, y, pairs, weight, ridge, 2.0)
    assert got == pytest.approx(w, abs=1e-4) and loss(got) <= loss(w) + 1e-9


def test_toxicity_learns_from_the_right_rows_only(spark):
    """Labels of held-out rows and all columns but the text change no score."""
    data = toxic_corpus(300)
    docs = spark.createDataFrame([(*x[:2], "en", "s", {"k": 1}) for x in data], "doc_id long, text string, lang string, source string, y map<string,int>")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    one = spark.createDataFrame([(x[0], x[2]) for x in data], "doc_id long, toxic int")
    two = spark.createDataFrame([(x[0], 1 - x[2] if held(x[0]) else x[2]) for x in data], "doc_id long, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity.score(d, lab).collect()} for d, lab in ((docs, one), (docs.select("doc_id", "text"), two)))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_toxicity_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "bad"), (2, "good"), (None, "bad"), (4, None), (4, ""), (5, "x" * 200000), (2, "good")], "doc_id long, text string")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 0.01 for r in toxicity.score(docs, none).collect()} == {True}
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0
