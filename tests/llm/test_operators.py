"""Each operator against a brute-force version, and on the cases that all of them must bear."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, bpe, common, jaccard, lines, lm, mixing, neardup, quality, secrets, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, keep string, size string"


def words(text):
    return (text or "").encode().split()


def corpus(seed=5):
    """Texts with copies, near copies, a shared passage, nulls, empty and long texts, ties and repeated rows."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    text = lambda n: "\n".join(" ".join(rnd.choice(vocab) for _ in range(12)) for _ in range(max(1, n // 12)))
    passage = text(72)
    out = []
    for i in range(60):
        x = text(rnd.randint(5, 150))
        if i % 7 == 0:
            x = x + "\n" + passage
        out.append([i, x])
    for i in range(60, 80):
        w = out[rnd.randrange(60)][1].split(" ")
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append([i, " ".join(w)])
    out += [[80, None], [81, ""], [82, " \n\t "], [83, "One"], [84, "one"], [85, "a b c d"], [86, text(6000)], [87, "é ß 東京 \x1c x\x85y z"], [None, "no id at all"], [None, None], [5, out[5][1]], [6, "another text of the sixth"]]
    rnd.shuffle(out)
    return [(i, x, rnd.choice(["en", None]), rnd.choice(["s1", "s2", "Ä", None]), None if x is None else len(x), "clash", "clash", "clash") for i, x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- secrets ---------------------------------------------------------------------------------------------------------


def test_secrets(spark, docs, empty):
    hexes = hashlib.sha256(b"x").hexdigest()
    texts = [f'Password = "{hexes[:10]}" and token:short', f"AKIA{'A1' * 10} {hexes}", "api_key=abcdef.ghi=", "secret: abc", None, "éé " + hexes[:24], "passwd='x" + "q" * 5]
    for i in range(200):
        texts.append(f"token = {hashlib.md5(str(i).encode()).hexdigest()} some_ordinary_identifier_{i} function_of_words")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secrets.train(d)
    got = {r.doc_id: r for r in secrets.scan(d, model, redact=True).collect()}
    assert [got[0].n_assign, got[1].n_access, got[1].n_hex, got[2].n_assign, got[3].n_assign, got[4].n_hex, got[5].n_hex, got[6].n_assign] == [1, 1, 1, 1, 0, 0, 1, 1]
    assert got[5].base_spans == "hex:3:27"
    assert got[5].redacted == "éé [SECRET]"
    assert set(got[0].base_spans.split(",")) <= set(got[0].spans.split(","))
    found = secrets.find("key " + hashlib.sha1(b"y").hexdigest()[:23] + " x", model, 20, 1.0)[1]
    assert found and found[0][1] == 3
    fresh = [hashlib.md5(f"fresh{i}".encode()).hexdigest() for i in range(100)]
    assert np.mean([model.score(x) > 0 for x in fresh]) > 0.95
    assert np.mean([model.score(f"another_ordinary_function_{i}") < 0 for i in range(100)]) > 0.95
    assert secrets.scan(docs, secrets.train(docs)).count() == docs.count()
    assert secrets.scan(empty, secrets.train(empty)).count() == 0


SIMPLE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def test_secrets_against_plain_patterns(spark, docs):
    """base_spans of whole texts by the patterns as they are written down, and spans that hold all of them."""
    rnd = random.Random(6)
    bits = ["password", "PassWd", "token", "apikey", "Api_Key", "secret", "AKIA", "AKIAAKIA", "=", ":", " ", "'", '"', "  = ", "\t", "\n", "é", "0a1b2c3d4e5f", "ABCDEF", "x.y-z/+_=", "9f" * 13, "Q7ZK" * 5, "the quick_brown_fox"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + [r[1] for r in corpus()]
    texts.append(" ".join(rnd.choice(bits) for _ in range(200_000)))  # many spans in one long text
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in secrets.scan(d, secrets.train(d)).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(SIMPLE) for m in p.finditer(x or "") if len(m[group]) >= least)
        assert got[i].base_spans == ",".join(f"{SIMPLE[k][0]}:{a}:{b}" for a, k, b in spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert not collections.Counter(filter(None, got[i].base_spans.split(","))) - collections.Counter(got[i].spans.split(","))


# --- BPE -------------------------------------------------------------------------------------------------------------


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode(docs).collect()}
    assert bpe.encode(docs).count() == docs.count()
    for i, x, *_ in corpus():
        ids = library.encode(x or "", add_special_tokens=False).ids
        r = got[i, len(ids)]
        if i not in (None, 5, 6):
            assert r.ids == ids
            assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert {r.decoded for r in bpe.decode(bpe.encode(docs)).collect()} == {r.decoded for r in got.values()}
    own = bpe.load(bpe.vocabulary_path())
    rnd = random.Random(2)
    pool = "abcABCΣσςİıß'’stdD \t\n\x0b\x85\xa0　\x1c\x1f12٣½中🙂́ﬁ<|>#-"
    for _ in range(3000):
        x = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25))) + rnd.choice(["", "<|endoftext|>"])
        assert own.encode(x)[1] == " ".join(map(str, library.encode(x, add_special_tokens=False).ids))
    assert bpe.encode(empty).count() == 0


def test_bpe_bounds_what_it_keeps(spark, monkeypatch):
    """A chunk of many MB without white space, and a store that starts anew all the time."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    long = "".join(f"w{i % 977}-x" for i in range(600_000))
    r = bpe.encode(spark.createDataFrame([(1, long + " " + long[:999])], "doc_id long, text string"), digests=True).first()
    ids = library.encode(long + " " + long[:999], add_special_tokens=False).ids
    assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    monkeypatch.setattr(bpe, "KEPT", 2000)
    monkeypatch.setattr(bpe, "PIECE", 50)
    own = bpe.WordBpe(bpe.vocabulary_path())
    for _, x, *_ in corpus():
        e = library.encode(x or "", add_special_tokens=False)
        assert own.encode(x or "") == (len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False))
    assert len(own.recent) + len(own.older) < 40


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by[r.source].append(r)
    for s, x in by.items():
        assert x[0].source_size == sum(r.size for r in x)
        smallest = min(r.size for r in x if r.size)
        assert 0 <= x[0].target - sum(r.taken for r in x) <= max(smallest, 0.1 * x[0].target), s
        assert x[0].target <= 2 * x[0].source_size + 1e-6
    total = sum(x[0].source_size for x in by.values())
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * total) < 1e-6 * total
    out = mixing.sample(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies if r.size else 1 for r in got)
    assert rows(mixing.sample(docs)) == rows(out)
    assert mixing.mix(empty).count() == 0
    assert mixing.sample(empty).count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, empty):
    rnd = random.Random(3)
    made = []
    for i in range(600):
        x = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "word"]) for _ in range(40))
        bad = i % 3 == 0
        made.append((i, x.upper() + "!!!" if bad and i % 2 else x + (" idiot" if bad else ""), "en", f"h{i % 5}", bad))
    d = spark.createDataFrame([m[:4] for m in made], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(not b or not i % 2), int(b and not i % 2)) for i, *_, b in made[:400]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(d, labels).collect()}
    assert np.mean([got[i] != b for i, *_, b in made[400:]]) > 0.97
    none = labels.limit(0)
    assert all(r.keep for r in quality.classify(docs, none).collect())
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.accepted(docs, none).columns == docs.columns
    assert rows(quality.accepted(docs, none)) == rows(docs)
    assert quality.classify(empty, none).count() == 0
    assert quality.classify(empty, labels).count() == 0


def test_sparse_sites_are_shrunk(spark):
    z = lambda p: math.log(p / (1 - p))
    d = spark.createDataFrame([("big", "a", z(0.9))] * 200 + [("low", "a", z(0.1))] * 200 + [("one", "a", z(0.1))], "h string, g string, __z double")
    got = {r.h: (r.s + r.strength * r.prior) / (r.n + r.strength) for r in quality.sites(d, "h", "g").collect()}
    assert got["big"] > 0.85 and got["low"] < 0.15 and got["one"] > got["low"]


def test_quality_by_hand(spark, docs):
    """Every path's and every document's posterior, from the documents' own odds."""
    d = docs.select("doc_id", "text", "lang", "source")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 11 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, labels, cut=0.6).collect()
    p = np.array([r.p_doc for r in got])
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for k, r in enumerate(got):
        hosts[r.source].append(k)
        paths[r.source, r.lang].append(k)

    def strength(groups, toward):
        n, rate = np.array([len(g) for g in groups]), np.array([p[g].mean() for g in groups])
        spread, chance = (n * (rate - toward) ** 2).sum() / n.sum(), (toward * (1 - toward)).sum() / n.sum()
        return max(1.0, (toward * (1 - toward)).mean() / max(1e-4, spread - chance) - 1)

    world = p.mean()
    k = strength(list(hosts.values()), np.full(len(hosts), world))
    prior = {h: (p[g].sum() + k * world) / (len(g) + k) for h, g in hosts.items()}
    s = strength(list(paths.values()), np.array([prior[h] for h, _ in paths]))
    odds = lambda x: np.log(x / (1 - x))
    for r in got:
        g = paths[r.source, r.lang]
        rest = (p[g].sum() - r.p_doc + s * prior[r.source]) / (len(g) - 1 + s)
        assert r.p_path == pytest.approx(rest, abs=1e-9)
        q = 1 / (1 + np.exp(-(odds(r.p_doc) + odds(rest) - odds(world))))
        assert r.p_quality == pytest.approx(q, abs=1e-9) and r.keep == (r.p_quality >= 0.6)


# --- lines -----------------------------------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_lines(docs, empty):
    data = [(i, x) for i, x in {(r[0], r[1]) for r in corpus()} if i is not None and x]
    at = sorted((i, x, k, y.strip(" ")) for i, x in data for k, y in enumerate(x.split("\n")) if y.strip(" "))
    first = {}
    for i, x, k, y in sorted(at, key=lambda r: (r[0], r[2])):
        first.setdefault(y, (i, x, k))
    split = {y: y.split(" ") for y in first}
    gone = {y for y in first if len(split[y]) >= 8 and any(first[z] < first[y] and len(split[z]) >= 8 and near(split[y], split[z]) for z in first if z != y)}
    want = collections.Counter()
    for i, x in [(r[0], r[1]) for r in corpus()]:
        if i is None or not x:
            want[i, x] += 1
            continue
        want[i, "\n".join(y for k, y in enumerate(x.split("\n")) if not (z := y.strip(" ")) or (z not in gone and first[z] == (i, x, k)))] += 1
    out = lines.dedup(docs)
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert gone and len(gone) < len(first)
    assert lines.dedup(empty).count() == 0


# --- substrings ------------------------------------------------------------------------------------------------------


def removed(data, window):
    least = {}
    for i, x in data:
        w = words(x)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, x in data:
        w, cut = words(x), set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                cut.update(range(k, k + window))
        out.append((i, len(w), len(cut), b" ".join(y for k, y in enumerate(w) if k not in cut).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "hot"), [(50, 2000), (50, 2), (6, 4), (3, 1), (50, 0), (3, 0)])
def test_substrings(docs, empty, window, hot):
    want = removed([(r[0], r[1]) for r in corpus()], window)
    assert any(n for _, _, n, _ in want)
    assert rows(substring.dedup(docs, window=window, hot=hot)) == want
    assert substring.dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [100_000, 20])
def test_substrings_of_one_word_and_of_many_copies(spark, hot, monkeypatch):
    """A long text of one word repeated, whose super-k-mer is the text, and a passage that very many share."""
    monkeypatch.setattr(substring, "LONGEST", 64)
    rnd = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(70))
    own = lambda i: " ".join(f"o{i}x{rnd.randrange(30)}" for _ in range(20))
    data = [(0, "ha " * 700), (1, "ha " * 320 + "end"), (2, "ha " * 49)] + [(i, f"{own(i)} {passage} {own(i)}") for i in range(10, 90)] + [(95, passage), (96, f"{passage} {passage}")]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert rows(substring.dedup(d, hot=hot)) == removed(data, 50)


# --- language model --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("vocabulary", [65_000, 20])
def test_lm(docs, empty, vocabulary):
    data = [(r[0], [w.lower() for w in words(r[1])] + [None]) for r in corpus()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, x in data if i is not None and not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 6)) for i, x in data)
    got = lm.score(docs, vocabulary=vocabulary).collect()
    assert collections.Counter((*r[:5], round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert out and all(r.score < 0 for r in got)
    if vocabulary > 100:
        seen = [r for r in got if not r.held_out]
        assert sum(r.score for r in seen) > sum(r.base_score for r in seen)
    assert lm.score(empty).count() == 0


@pytest.mark.parametrize("vocabulary", [65_000, 800, 20])
def test_lm_counts_all_words_and_pairs(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(lm, "PART", 500)
    rnd = random.Random(3)
    texts = [r[:2] for r in corpus()] + [(i, " ".join(f"w{int(rnd.paretovariate(0.4)) % 4000}" for _ in range(300))) for i in range(100, 140)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    data = [(i, [w.lower() for w in words(x)] + [None]) for i, x in texts]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    pairs = lambda x: list(zip([None, *x], x, strict=False))
    known = [x for i, x in data if i is not None and not held(i)]
    one, two = collections.Counter(w for x in known for w in x), collections.Counter(p for x in known for p in pairs(x))
    uniform = 1 / (len(one) + 1)

    def rates(x):
        a, b = (np.array([one[p[i]] for p in pairs(x)], float) for i in (0, 1))
        return np.minimum(np.frexp(a)[1], lm.BUCKETS - 1), np.array([two[p] for p in pairs(x)]) / np.maximum(1, a), b / sum(one.values())

    # The training texts set aside, measured by the counts of the rest; EM over single events, without rounded rates.
    row = F.xxhash64("doc_id", "text")
    aside = {tuple(r) for r in docs.where(F.pmod(F.xxhash64(row, F.lit("aside")), F.lit(lm.FIT)) == 0).collect()}
    is_aside = [(i, x) in aside and i is not None and not held(i) for i, x in texts]
    assert 3 < sum(is_aside) < 40
    events, rest = [x for (_, x), a in zip(data, is_aside, strict=True) if a], [x for (i, x), a in zip(data, is_aside, strict=True) if not a and i is not None and not held(i)]
    one_left, two_left = collections.Counter(w for x in rest for w in x), collections.Counter(p for x in rest for p in pairs(x))
    size = sum(one_left.values())
    by = collections.defaultdict(list)
    for x in events:
        for a, b in pairs(x):
            bucket = min(int(np.frexp(float(one_left[a]))[1]), lm.BUCKETS - 1)
            by[bucket].append((two_left[a, b] / max(1, one_left[a]), one_left[b] / size, uniform))

    def em(rows):
        f, w = np.array(rows), np.full(3, 1 / 3)
        for _ in range(60):
            share = f * w
            w = (share / share.sum(1, keepdims=True)).mean(0)
        return np.maximum(w, 1e-7) / np.maximum(w, 1e-7).sum()

    pooled = em([e for k, x in by.items() if k for e in x])
    weights = np.array([em(by[k]) if k in by else pooled for k in range(lm.BUCKETS)])

    def score(x):
        b, f2, f1 = rates(x)
        return np.log10(weights[b, 0] * f2 + weights[b, 1] * f1 + weights[b, 2] * uniform).sum()

    want = sorted((str(i), len(x), round(score(x), 5)) for i, x in data)
    got = sorted((str(r.doc_id), r.n_tokens, round(r.score, 5)) for r in lm.score(docs, vocabulary=vocabulary).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=5e-3, abs=0.3)  # the fit rounds rates, which tells where a bucket has few events


def test_lm_learns_nothing_from_held_out_texts(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rnd = random.Random(9)
    data = [(i, " ".join(f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(60))) for i in range(120)]
    other = [(i, "quite other words " * 40 if held(i) else x) for i, x in data]
    assert sum(held(i) for i, _ in data) > 3
    a, b = ({r.doc_id: tuple(r) for r in lm.score(spark.createDataFrame(x, "doc_id long, text string")).collect() if not r.held_out} for x in (data, other))
    assert a.keys() == b.keys()
    for i in a:
        assert a[i][:5] == b[i][:5] and a[i][5:] == pytest.approx(b[i][5:], abs=1e-9)


def test_lm_sums_to_one(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(["a b a c", "b a", "c c a b", "a", "a b"] * 5)], "doc_id long, text string")
    total = 0.0
    texts = ["", *"abc", *(x + " " + y for x in "abc" for y in "abc"), *(f"{x} {y} {z}" for x in "abc" for y in "abc" for z in "abc")]
    probe = spark.createDataFrame([(None, x) for x in texts], "doc_id long, text string")
    for r in lm.score(d.union(probe)).where("doc_id is null").collect():
        total += 10**r.score
    assert total <= 1


def test_em_prefers_what_explains():
    grades, n = lm._grades(np.full(1000, 3), np.full(1000, 0.5), np.full(1000, 1e-4), 1e-5)
    w = lm.learn(grades, n.astype(float), 1e-5)
    assert w[3, 0] > 0.99 and abs(w.sum(1) - 1).max() < 1e-9


# --- words that polynomial hashes take for one -----------------------------------------------------------------------


def thue_morse(a, b, k=10):
    x = [0]
    for _ in range(k):
        x += [1 - y for y in x]
    return "".join(b if y else a for y in x), "".join(a if y else b for y in x)


def test_words_that_polynomials_confuse(spark):
    """For the words of Thue and Morse, every polynomial hash modulo a power of two is the same."""
    a, b = thue_morse("a", "b")
    d = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.join(d).collect()} == {(1, 1), (2, 2)}
    tail = " ".join(f"w{i}" for i in range(49))
    d = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{b} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup(d).collect()} == {1: 0, 2: 0, 3: 50}
    x, y = thue_morse("p ", "q ", 9)
    d = spark.createDataFrame([(1, x), (2, y), (3, y)], "doc_id long, text string")
    assert rows(substring.dedup(d)) == removed([(1, x), (2, y), (3, y)], 50)


def test_windows_behind_one_fingerprint(spark, monkeypatch):
    """With a fingerprint that says nothing, windows are parted by themselves."""
    monkeypatch.setattr(common.Words, "grams", lambda self, k, seed=0: np.full(max(0, len(self.hash) - k + 1), 7, np.uint64))
    rnd = random.Random(1)
    data = [(i, " ".join(rnd.choice("abcd") for _ in range(40))) for i in range(12)]
    buf = [b" ".join(x.encode().split()) for _, x in data]
    ids = np.arange(12)
    found = collections.defaultdict(set)
    for r, a, b, _ in zip(*substring._met(ids, ids, buf, 3), strict=True):
        found[int(r)].update(range(a, b))
    want = {i: n for i, n, *_ in ((r[0], r[2]) for r in removed(data, 3)) if n}
    assert {i: len(x) for i, x in found.items()} == want


def test_sets_behind_one_key(spark, monkeypatch):
    """Where two sets share a key, all keys are formed anew by the next seed."""
    real = jaccard._keys
    monkeypatch.setattr(jaccard, "_keys", lambda h, doc, docs, seed: (np.zeros(docs, np.uint64), *real(h, doc, docs, seed)[1:]) if seed == 0 else real(h, doc, docs, seed))
    d = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two")], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.component_id) for r in jaccard.join(d).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_batches_are_bounded_in_every_session(spark):
    for s in (spark, spark.newSession()):
        common.in_arrow(s.range(1), lambda b: b, "id long")
        assert s.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == common.BATCH_BYTES
    s = spark.newSession()
    s.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "9MB")
    common.in_arrow(s.range(1), lambda b: b, "id long")
    assert s.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "9MB"


# --- Jaccard ---------------------------------------------------------------------------------------------------------


def shingle_set(x, k=5):
    w = [y.lower() for y in words(x)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def grouped(data):
    """Component of each row by comparing all pairs."""
    sets = [shingle_set(x) if i is not None else set() for i, x in data]
    up = list(range(len(data)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(data)):
        for b in range(a):
            s = len(sets[a] & sets[b])
            if s and 100 * s >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(data):
        if sets[a]:
            least[root(a)] = min(least.get(root(a), i), i)
    return [(i, len(shingle_set(x)), least[root(a)] if sets[a] else i) for a, (i, x) in enumerate(data)]


def near_copies():
    """A large group of near copies, each of which has other words changed, and a chain whose ends are far apart."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    out = []
    for i in range(100, 160):
        w = base.copy()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(1000)}"
        out.append((i, " ".join(w)))
    w = [f"c{k}" for k in range(80)]
    for i in range(200, 212):
        out.append((i, " ".join(w)))
        w[7 * (i - 200) : 7 * (i - 200) + 1] = [f"d{i}"]
    return out


@pytest.mark.parametrize("frequent", [24, 2])
def test_jaccard(spark, docs, empty, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    data = [(r[0], r[1]) for r in corpus()] + near_copies()
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = jaccard.join(d).select("doc_id", "n_shingles", "component_id")
    assert rows(got) == sorted(grouped(data), key=str)
    stay = jaccard.distinct(docs)
    assert stay.columns == docs.columns
    comp = {i: c for i, _, c in grouped([(r[0], r[1]) for r in corpus()]) if i is not None}
    ids = [r.doc_id for r in stay.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) or collections.Counter(ids).most_common(1)[0][1] == 2  # id 6 has two different texts
    assert set(ids) == {i for i in comp if comp[i] == i}
    assert jaccard.join(empty).count() == 0
    assert jaccard.distinct(empty).count() == 0


# --- embeddings ------------------------------------------------------------------------------------------------------


def vectors(seed=1, n=1500, d=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for a in range(0, n, 5):
        x[a] = x[0 if a < n // 3 else max(0, a - 5)] + 0.02 * rng.standard_normal(d)
    x = x.astype(np.float32)
    out = [(i, [float(y) for y in v], int(i % 3) if i % 5 else 0) for i, v in enumerate(x)]
    out[7] = (7, None, 1)
    out[8] = (8, [0.0] * d, 1)
    out[9] = (9, [float("nan")] + [1.0] * (d - 1), 1)
    out[11] = (11, [None] + [1.0] * (d - 1), 1)
    out[12] = (12, [1.0] * (d + 1), 1)
    out[13] = (13, out[14][1], out[14][2])
    out[16] = (16, out[16][1], None)
    out[17] = (None, out[18][1], 1)
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def taking_part(data, d=16):
    return [(i, np.array(v, float), c) for i, v, c in data if i is not None and v is not None and len(v) == d and None not in v and np.isfinite(v).all() and any(v)]


def test_ann(spark):
    data = vectors()
    d = spark.createDataFrame(data, VECTORS)
    part = taking_part(data)
    ids, x = np.array([p[0] for p in part]), np.stack([p[1] for p in part])
    got = collections.defaultdict(list)
    for r in ann.search(d, d.vec_id % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    queries = [i for i in ids if i % 20 == 0]
    assert set(got) == set(queries)
    hits = 0
    for q in queries:
        v = x[ids == q][0]
        s = (x * v).sum(1)
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        assert len(got[q]) == 20 and q not in [a for a, _ in got[q]]
        assert all(abs(b - (x[ids == a][0] * v).sum()) < 1e-9 for a, b in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))
        hits += len({a for a, _ in got[q]} & set(want.tolist()))
    assert hits / (20 * len(queries)) >= 0.9
    few = spark.createDataFrame(data[20:24], VECTORS)
    assert ann.search(few, few.vec_id % 20 == 0).count() == 3
    assert ann.search(d.limit(0), d.vec_id % 20 == 0).count() == 0


def plain_ann(part, k=20):
    """query -> [(id, score)] by brute force, for rows (id, v) that may repeat ids."""
    out = {}
    queries = {}
    for i, v in part:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        best = {}
        for i, x in part:
            if i != q and len(x) == len(v):
                best[i] = max(best.get(i, -np.inf), float(np.dot(x, v)))
        out[q] = sorted(best.items(), key=lambda r: (-round(r[1], 9), r[0]))[:k]
    return out


@pytest.mark.parametrize("n", [1, 2, 20, 21, 24, 28, 32, 40])
def test_ann_of_few_rows(spark, n):
    """As many neighbours as there are candidates, up to 20, however few rows there are; ties, and columns with other names."""
    rng = np.random.default_rng(n)
    x = rng.integers(-2, 3, (n, 6)).astype(float) + 0.25
    data = [(i, x[i].tolist(), 0, "clash", 1.0) for i in range(n)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>, query_id int, rank string, score double")
    want = plain_ann([(r[0], r[1]) for r in data])
    got = collections.defaultdict(list)
    for r in ann.search(d, d.vec_id % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, near in want.items():
        assert [round(s, 6) for _, s in got[q]] == [round(s, 6) for _, s in near]
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))


def test_ann_of_repeated_ids_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.integers(-9, 10, 8).astype(float).tolist()) for i in range(300)]
    data += [(40, v) for v in [data[7][1]] * 300]  # one id, very many rows
    data += [(1000 + i, rng.integers(-9, 10, 5).astype(float).tolist()) for i in range(30)] + [(2000, [1.0])]
    got = collections.defaultdict(list)
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    for r in ann.search(d, d.vec_id % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = plain_ann(data)
    assert set(got) == {q for q in want if want[q]}
    hits = 0
    for q in got:
        assert len(got[q]) == len(want[q]) == len({i for i, _ in got[q]})
        hits += len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q])
    assert hits / len(got) >= 0.9


def plain_links(part):
    """(links, component) of each id by comparing all of (id, v, label)."""
    links, up = collections.Counter(), {i: i for i, _, _ in part}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(part)):
        for b in range(a):
            (i, v, p), (j, w, q) = part[a], part[b]
            if p == q and len(v) == len(w) and np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (links[i], root(i)) for i in up}


def test_neardup_of_other_lengths_and_components(spark):
    """Equal vectors of a rare length are linked, and every component and number of links is that of all pairs."""
    data = [r for r in vectors(seed=5, n=400) if r[0] is not None]
    data += [(1000, [1.0, 2.0, 3.0, 4.0, 5.0], 0), (1001, [1.0, 2.0, 3.0, 4.0, 5.0], 0), (1002, [2.0, 4.0, 6.0, 8.0, 10.0], 0), (1003, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (1004, [3.0], 0), (1005, [7.0], 0)]
    d = spark.createDataFrame([(*r, "clash", 7) for r in data], VECTORS + ", n_links string, component_id int").repartition(3)
    part = [(i, np.array(v, float), c) for i, v, c in data if v is not None and c is not None and None not in v and np.isfinite(v).all() and any(v)]
    want = plain_links(part)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.dedup(d).collect()}
    assert got == {i: want.get(i, (0, i)) for i, _, _ in data}
    assert got[1001] == (2, 1000) and got[1004] == (1, 1004)


def test_neardup(spark):
    data = vectors()
    d = spark.createDataFrame(data, VECTORS).repartition(3)
    part = [p for p in taking_part(data) if p[2] is not None]
    ids, x, label = np.array([p[0] for p in part]), np.stack([p[1] for p in part]), np.array([p[2] for p in part])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    want = dict(zip(ids.tolist(), linked.sum(1).tolist(), strict=True))
    got = {r.vec_id: r for r in neardup.dedup(d).collect()}
    assert len(got) == len(data)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(want.values()) > 0
    for i, r in got.items():
        assert r.n_links <= want.get(i, 0)
        assert r.kept == (i is None or r.component_id == i)
    assert got[8].n_links == got[16].n_links == 0 and got[8].component_id == 8
    assert neardup.dedup(d.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [4096, 300])
def test_neardup_in_a_tight_label(spark, bucket):
    """All vectors of a label lie close together, and pairs at the threshold are linked with nothing else."""
    rng = np.random.default_rng(4)
    n, d = 3000, 64
    middle, apart = rng.standard_normal(d), lambda s: s * rng.standard_normal((n // 2, d))
    x = np.repeat(middle[None] + apart(0.45), 2, axis=0)
    x[1::2] += 0.95 * np.sqrt(0.04 / d) * np.linalg.norm(x[::2], axis=1)[:, None] * rng.standard_normal((n // 2, d))
    x = x[rng.permutation(n)].astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.98
    np.fill_diagonal(linked, False)
    rows_ = [(i, [float(y) for y in v], 1) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in neardup.dedup(spark.createDataFrame(rows_, VECTORS).repartition(3), bucket=bucket).collect()}
    found = sum(got.values()) / linked.sum()
    assert linked.sum() > 1000 and all(got[i] <= k for i, k in enumerate(linked.sum(1)))
    assert found == 1 if bucket > n else found >= 0.995


def test_neardup_windows_of_a_clustered_label(spark):
    """Small windows and short runs: groups of copies and lone pairs of a label are those of all pairs; labels and ids may be text."""
    rng = np.random.default_rng(9)
    data = []
    for c in range(220):
        middle = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 9)) if c else 300):
            v = middle + 0.06 * rng.standard_normal(32)
            data.append((len(data), [float(y) for y in v], 4))
    want = plain_links([(i, np.array(v), c) for i, v, c in data])
    d = spark.createDataFrame(data, VECTORS).repartition(3)
    d = d.select(d.vec_id.cast("string"), "embedding", d.label.cast("string"))
    d = d.union(spark.createDataFrame([("a1", data[0][1], "4"), (None, data[0][1], "4")], d.schema))
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.dedup(d, window=8, bucket=64).collect()}
    assert {i: got[str(i)] for i in want} == want
    assert got["a1"] == (0, None) and len(got) == len(data) + 2
