"""Graph analytics on edges(src, dst, weight) and vertices(id) (§2.13). An edge stands for both directions."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Betweenness runs from at most so many vertices (above that it is estimated, as stated there). Searches run in tasks that hold
#: the adjacency up to so many edges, and as joins beyond.
PIVOTS, ADJACENCY = 2000, 8_000_000
#: Words of 64 searches each that a task runs at once, where a word of all vertices stays below SEARCHED.
WORDS, SEARCHED, EDGES_AT_ONCE = 8, 12_000_000, 1 << 19
#: Neighbours of each vertex that are taken in one after the other, for all vertices at once; most names have two.
ONE_BY_ONE = 4
#: Vertices up to which resolutions are compared.
SWEPT = 10_000
#: Edges, both ways, and vertices that a task has in a round of communities; edges up to which a round of components is one task; after how many rounds the vertices' turns recur.
EDGES_A_TASK, TURNS = 1 << 17, 48


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own in local mode, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, so that loops keep short plans and survive lost executors."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(at.toString())
    return spark.read.schema(df.schema).parquet(at.toString())


def simple(edges: DataFrame) -> DataFrame:
    """GRF-1: one edge for each unordered pair, without loops; weights are summed."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"))
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """GRF-2: degree, weighted degree and degree centrality (degree over all others)."""
    d = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    n = vertices.agg(F.count("*").alias("n"))
    j = vertices.select("id").join(d, "id", "left").crossJoin(F.broadcast(n))  # n is one row
    deg = F.coalesce("degree", F.lit(0))
    return j.select("id", deg.alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.when(F.col("n") > 1, deg / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("centrality"))


def pagerank(edges: DataFrame, vertices: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """GRF-4: (id, rank) by power iteration over weights; the mass of vertices without edges goes to all. Stops after so
    many rounds or when the ranks move by less than tolerance a vertex (None: always all rounds)."""
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    e, v = both_ways(edges), vertices.select("id")
    out = e.groupBy("src").agg(F.sum("weight").alias("total"))
    share = e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    share = cut(share.join(v.select(F.col("id").alias("dst")), "dst", "left_semi")).repartition("src")  # one shuffle for all rounds of a plan
    rank = cut(v.join(out.select(F.col("src").alias("id")), "id", "left_semi").select("id", F.lit(1.0 / n).alias("rank")))
    # Vertices without edges get what all get and nothing else, so they keep equal ranks, whose sum needs no look at them.
    idle, alone = n - rank.count(), 1.0 / n
    for i in range(rounds):
        base = damping * idle * alone / n + (1 - damping) / n
        sent = share.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = sent.select("id", (damping * F.col("got") + base).alias("rank"))
        if tolerance is None:
            rank, alone = new if i % 8 < 7 else cut(new), base
            continue
        new = cut(rank.withColumnRenamed("rank", "old").join(new, "id", "left").select("id", F.coalesce("rank", F.lit(base)).alias("rank"), "old"))
        moved = (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) + idle * abs(base - alone)
        rank, alone = new.drop("old"), base
        if moved < tolerance * n:
            break
    return v.join(rank, "id", "left").select("id", F.coalesce("rank", F.lit(alone)).alias("rank"))


def eigenvector(edges: DataFrame, vertices: DataFrame, rounds: int = 100, tolerance: float = 1e-3) -> DataFrame | None:
    """GRF-6: power iteration on adjacency plus identity; None where it does not settle."""
    n = vertices.count()
    e = both_ways(edges)
    x = vertices.select("id", F.lit(1.0 / max(1, n) ** 0.5).alias("x"))
    for _ in range(rounds):
        got = e.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("weight")).alias("g"))
        y = x.join(got, "id", "left").select("id", F.col("x").alias("old"), (F.col("x") + F.coalesce("g", F.lit(0.0))).alias("y"))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        new = cut(y.select("id", (F.col("y") / norm).alias("x"), "old"))
        moved = new.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0
        x = new.drop("old")
        if moved < tolerance * max(1, n):
            return x
    return None


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """GRF-9, SIM-6: (id, component), the smallest id reachable, by large-star and small-star rounds."""
    e = cut(edges.where("src <> dst").selectExpr("greatest(src, dst) AS u", "least(src, dst) AS v").distinct())
    few = e.count() <= EDGES_A_TASK  # then a round is one stage
    before = None
    while True:
        both = (e.coalesce(1) if few else e).selectExpr("stack(2, u, v, v, u) AS (u, v)")
        m = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(m.hint("merge") if few else m, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge") if few else down, "u").selectExpr("stack(2, u, m, v, m) AS (u, v)")
        e = cut(small.where("u <> v").distinct())
        now = tuple(e.selectExpr("count(*)", "bit_xor(xxhash64(u, v))").first())
        if now == before:
            break
        before = now
    roots = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return vertices.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def clustering(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """GRF-8: (id, triangles, clustering). Edges point from the smaller degree, so that hubs make few wedges."""
    deg = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    e = edges.join(deg.select(F.col("id").alias("src"), F.col("d").alias("a")), "src").join(deg.select(F.col("id").alias("dst"), F.col("d").alias("b")), "dst")
    up = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("src") < F.col("dst")))
    o = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y"))
    wedges = o.alias("p").join(o.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.y").alias("z"))
    closed = wedges.join(edges.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"])
    tri = closed.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    j = vertices.select("id").join(deg, "id", "left").join(tri, "id", "left")
    t, d = F.coalesce("t", F.lit(0)), F.coalesce("d", F.lit(0))
    return j.select("id", t.alias("triangles"), F.when(d > 1, 2.0 * t / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering"))


def statistics(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """AGG-15, GRF-7: nodes, edges, density, mean clustering, components and the largest, in one row."""
    n, m = vertices.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    c = clustering(edges, vertices).agg(F.avg("clustering").alias("clustering"))
    s = components(edges, vertices).groupBy("component").count().agg(F.count("*").alias("components"), F.max("count").alias("largest"))
    one = n.crossJoin(m).crossJoin(c).crossJoin(s)  # single rows
    return one.withColumn("density", F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0)))


def _adjacency(edges: DataFrame, kind: str) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """known(id, at), the vertices that have edges, numbered, and of each by number where its neighbours start in the first array.
    For tasks that hold the adjacency: 8 bytes an edge and 8 a vertex."""
    ids = both_ways(edges).select(F.col("src").alias("id")).distinct()
    ids = cut(ids.select("id", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    many = ids.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    start = many.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    at = F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    known = cut(ids.withColumn("part", part).join(F.broadcast(start), "part").select("id", at.alias("at")))
    vertices = known.count()
    a, b = (known.select(F.col("id").alias(c), F.col("at").cast("int").alias(x)) for c, x in (("src", "a"), ("dst", "b")))
    pairs = edges.join(a, "src").join(b, "dst").select("a", "b").toArrow()  # at most the edges held
    a, b = (pairs[c].to_numpy() for c in ("a", "b"))
    place, adjacent = np.append(a, b), np.append(b, a)
    order = np.argsort(place, kind="stable")
    return known, (adjacent[order], np.searchsorted(place[order], np.arange(vertices)))


def _renumbered(adjacent: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The adjacency by other numbers, and the old number of each: in the order of a search from the vertex with the most edges, so that
    neighbours lie side by side. What that search doesn't reach comes last."""
    size, met = np.diff(np.append(first, len(adjacent))), np.zeros(len(first), bool)
    front, found = np.array([size.argmax()]) if len(first) else np.array([], np.int64), []
    while len(front):
        met[front] = True
        found.append(front)
        many = size[front]
        w = adjacent[np.repeat(first[front] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())]
        w = w[~met[w]]
        front = w[np.sort(np.unique(w, return_index=True)[1])]
    order = np.concatenate([*found, np.flatnonzero(~met)]).astype(np.int64)
    place = np.empty(len(first), np.int32)
    place[order] = np.arange(len(first))
    many = size[order]
    start = np.append(0, np.cumsum(many))[:-1]
    return place[adjacent[np.repeat(first[order] - start, many) + np.arange(many.sum())]], start, order


def _added(into: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    if len(at) > len(into) // 16:
        into += np.bincount(at, values, len(into))
    else:
        np.add.at(into, at, values)


def _paths_through(s: int, adjacent: np.ndarray, first: np.ndarray, size: np.ndarray, gain: np.ndarray) -> None:
    """Adds to gain, of each other vertex, the shares of the shortest paths from s that lead through it: level by level, over all
    edges of a level at once."""
    n = len(first)
    far, paths = np.full(n, -1, np.int32), np.zeros(n)
    far[s], paths[s] = 0, 1.0
    front, steps = np.array([s]), []
    while len(front):
        many = size[front]
        edge = np.repeat(first[front] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        v, w = np.repeat(front, many), adjacent[edge]
        new = far[w] < 0
        far[w[new]] = len(steps) + 1
        onward = far[w] == len(steps) + 1
        v, w = v[onward], w[onward]
        _added(paths, w, paths[v])
        steps.append((v, w))
        front = np.unique(w) if len(w) <= n // 16 else np.flatnonzero(far == len(steps))
    own = np.zeros(n)
    for v, w in reversed(steps):
        _added(own, v, paths[v] / paths[w] * (1 + own[w]))
    own[s] = 0.0
    gain += own


def _paths_joined(edges: DataFrame, chosen: DataFrame, block: int) -> DataFrame:
    """As _paths_through, for `block` sources at a time, level by level, as joins."""
    e = cut(both_ways(edges).select("src", "dst").distinct())
    n = -(-chosen.count() // block)
    place, out = cut(chosen.select("id", F.pmod(F.xxhash64("id"), F.lit(max(1, n))).alias("block"))), None
    for b in range(n):
        levels = [cut(place.where(F.col("block") == b).select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")))]
        met = levels[0].select("source", "id")
        while not levels[-1].isEmpty():
            new = e.join(levels[-1].withColumnRenamed("id", "src"), "src").groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
            levels.append(cut(new.join(met, ["source", "id"], "left_anti")))
            met = met.union(levels[-1].select("source", "id"))
        gain = levels[-1].select("source", "id", "paths", F.lit(0.0).alias("g"))
        for level in reversed(levels[:-1]):
            sent = gain.select("source", F.col("id").alias("dst"), ((1 + F.col("g")) / F.col("paths")).alias("share"))
            got = e.join(sent, "dst").groupBy("source", F.col("src").alias("id")).agg(F.sum("share").alias("share"))
            gain = cut(level.join(got, ["source", "id"], "left").select("source", "id", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("g")))
            part = gain.where("source <> id and g > 0").select("id", "g")
            out = part if out is None else out.union(part)
    return out


def _paths_held(edges: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    """(id, g): the shares of the paths from the vertices chosen, summed in tasks that hold the adjacency."""
    known, arrays = _adjacency(edges, kind)
    held = edges.sparkSession.sparkContext.broadcast(arrays)

    def run(batches):
        adjacent, first = held.value
        size, gain = np.diff(np.append(first, len(adjacent))), np.zeros(len(first))
        for df in batches:
            for s in df["at"]:
                _paths_through(s, adjacent, first, size, gain)
        at = np.flatnonzero(gain)
        for k in range(0, len(at), 10_000):
            yield pd.DataFrame({"at": at[k : k + 10_000], "g": gain[at[k : k + 10_000]]})

    start = known.join(chosen, "id", "left_semi").select("at").repartition(48)
    return start.mapInPandas(run, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).join(known, "at").select("id", "g")


def betweenness(edges: DataFrame, vertices: DataFrame, pivots: int = PIVOTS, sent: int = ADJACENCY, block: int = 200) -> DataFrame:
    """GRF-3: the share of shortest paths through each vertex; exact up to `pivots` vertices, and above that estimated from
    so many, those with the smallest hashes of their ids, as is the operator's definition. Beyond `sent` edges, searches run
    as joins, from `block` vertices at a time."""
    n = vertices.count()
    kind = vertices.schema["id"].dataType.simpleString()
    k = min(pivots, n)
    chosen = vertices.select("id").orderBy(F.xxhash64("id"), "id").limit(pivots)
    got = _paths_held(edges, chosen, kind) if edges.count() <= sent else _paths_joined(edges, chosen, block)
    scale = (n / max(1, k)) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if got is None:
        return vertices.select("id", F.lit(0.0).alias("betweenness"))
    got = got.groupBy("id").agg(F.sum("g").alias("g"))
    return vertices.select("id").join(got, "id", "left").select("id", (F.coalesce("g", F.lit(0.0)) * scale).alias("betweenness"))


def _far(df: pd.DataFrame, adjacent: np.ndarray, first: np.ndarray, n: int) -> pd.DataFrame:
    """Closeness and eccentricity of some vertices (at), whose searches run together, one bit of a word each, and of the leaves at
    them: a leaf is one step farther from all. A round looks only at vertices that border on the last one's and that a search
    has yet to reach."""
    words, at = -(-len(df) // 64), df["at"].to_numpy()
    seen, i = np.zeros((len(first), words), np.uint64), np.arange(len(df))
    np.bitwise_or.at(seen, (at, i // 64), np.uint64(1) << (i % 64).astype(np.uint64))
    all_ = np.bitwise_or.reduce(seen, axis=0)
    front, far, total, reached, most = seen.copy(), 0, np.zeros(64 * words, np.int64), np.zeros(64 * words, np.int64), np.zeros(64 * words, np.int32)
    size, open_, reach = np.diff(np.append(first, len(adjacent))), np.ones(len(first), bool), front.any(1)
    while True:
        far += 1
        rows = np.flatnonzero(np.logical_or.reduceat(reach[adjacent], first) & open_)
        near, new = np.empty((len(rows), words), np.uint64), np.zeros(64 * words, np.int64)
        for a in range(0, len(rows), EDGES_AT_ONCE // words):  # so that what is gathered at once is bounded
            part = rows[a : a + EDGES_AT_ONCE // words]
            got, more = front[adjacent[first[part]]], np.arange(len(part))
            for j in range(1, ONE_BY_ONE):
                more = more[size[part[more]] > j]
                got[more] |= front[adjacent[first[part[more]] + j]]
            more = more[size[part[more]] > ONE_BY_ONE]
            while len(more):  # the neighbours that are left of some of them
                left = size[part[more]] - ONE_BY_ONE
                ends = np.append(0, np.cumsum(left))
                k = max(1, int(np.searchsorted(ends, EDGES_AT_ONCE // words, "right")) - 1)
                edge = np.repeat(first[part[more[:k]]] + ONE_BY_ONE - ends[:k], left[:k]) + np.arange(ends[k])
                got[more[:k]] |= np.bitwise_or.reduceat(front[adjacent[edge]], ends[:k], axis=0)
                more = more[k:]
            near[a : a + len(part)] = got & ~seen[part]
        some = near.any(1)
        front[reach] = 0
        reach[:] = False
        rows, near = rows[some], near[some]
        if not len(rows):
            break
        for k in range(0, len(near), 1 << 14):
            new += np.unpackbits(near[k : k + (1 << 14)].astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        front[rows], reach[rows] = near, True
        seen[rows] |= near
        open_[rows] = (seen[rows] != all_).any(1)
        total, reached = total + far * new, reached + new
        most[new > 0] = far
    total, reached, most = (x[: len(df)] for x in (total, reached, most))
    edge = np.repeat(first[at] - np.append(0, np.cumsum(size[at])[:-1]), size[at]) + np.arange(size[at].sum())
    leaf, of = adjacent[edge], np.repeat(i, size[at])
    hangs = (size[leaf] == 1) & (size[at[of]] > 1)
    leaf, of = leaf[hangs], of[hangs]
    at, total, reached, most = np.append(at, leaf), np.append(total, total[of] + reached[of] - 1), np.append(reached, reached[of]), np.append(most, most[of] + 1)
    return pd.DataFrame({"at": at, "closeness": reached / np.maximum(1, total) * reached / max(1, n - 1), "eccentricity": most})


def closeness(edges: DataFrame, vertices: DataFrame, block: int = 500, sent: int = ADJACENCY) -> DataFrame:
    """GRF-5, GRF-10: closeness within the component, weighted by its share of the graph, and eccentricity, of every vertex.
    Beyond `sent` edges, searches run as joins, from `block` vertices at a time."""
    n = vertices.count()
    kind = vertices.schema["id"].dataType.simpleString()
    if edges.count() <= sent:
        known, arrays = _adjacency(edges, kind)
        spark, size = edges.sparkSession, len(arrays[1])
        held = spark.sparkContext.broadcast(_renumbered(*arrays))

        def run(batches):
            adjacent, first, order = held.value
            step = 64 * max(1, min(WORDS, SEARCHED // max(1, len(first))))
            size = np.diff(np.append(first, len(adjacent)))
            for df in batches:
                at = df["at"].to_numpy()
                df = df[(size[at] > 1) | (size[adjacent[first[at]]] == 1)]  # leaves come with what they hang on
                for k in range(0, len(df), step):
                    yield _far(df.iloc[k : k + step], adjacent, first, n).assign(at=lambda x: order[x["at"]])

        # A task searches from vertices near each other, which reach the others at about the same time.
        got = spark.range(0, size, 1, max(8, min(256, size // 512))).toDF("at").mapInPandas(run, "at long, closeness double, eccentricity int").join(known, "at")
        return vertices.select("id").join(got, "id", "left").select("id", F.coalesce("closeness", F.lit(0.0)).alias("closeness"), F.coalesce("eccentricity", F.lit(0)).alias("eccentricity"))
    e = cut(both_ways(edges).select("src", "dst").distinct())
    place = vertices.select("id", F.pmod(F.xxhash64("id"), F.lit(-(-n // block))).alias("block"))
    place, out = cut(place), None
    for b in range(-(-n // block)):
        front = place.where(F.col("block") == b).select(F.col("id").alias("source"), "id", F.lit(0).alias("far"))
        met, far = cut(front), 0
        while not front.isEmpty():
            far += 1
            new = e.join(front.withColumnRenamed("id", "src"), "src").select("source", F.col("dst").alias("id")).distinct()
            new = new.join(met.select("source", "id"), ["source", "id"], "left_anti").withColumn("far", F.lit(far))
            front = cut(new)
            met = met.union(front)
        total, r = F.sum("far"), F.count("*") - 1
        value = F.when(total > 0, r / total * r / F.lit(n - 1)).otherwise(F.lit(0.0))
        got = cut(met.groupBy(F.col("source").alias("id")).agg(value.alias("closeness"), F.max("far").cast("int").alias("eccentricity")))
        out = got if out is None else out.union(got)
    return out


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 3, per_hop: int | None = 50, keep: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """JN-13, JN-14: (by, id, hop) of vertices reached from seeds(by, id), nearest first, at most per_hop new ones in each hop
    (those with the smallest ids), filtered by keep before the limit. by: columns, such as a query's id, whose seeds are
    expanded each on their own, with limits of their own. A seed is returned only if it is reached again."""
    e, by = both_ways(edges).select("src", "dst"), list(by)
    front, out = seeds.select(*by, "id").distinct(), None
    for h in range(1, hops + 1):
        new = e.join(front.withColumnRenamed("id", "src"), "src").select(*by, F.col("dst").alias("id")).distinct()
        if keep is not None:
            new = new.join(keep.select("id"), "id", "left_semi")
        if out is not None:
            new = new.join(out.select(*by, "id"), [*by, "id"], "left_anti")
        if per_hop is not None and by:
            new = new.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("__r") <= per_hop)
        elif per_hop is not None:
            new = new.orderBy("id").limit(per_hop)
        new = new.select(*by, "id", F.lit(h).alias("hop"))
        out = cut(new if out is None else out.union(new))
        front = out.where(F.col("hop") == h).select(*by, "id")
    return out


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """GRF-15: of labels(id, community), in one row."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("p")), labels.select(F.col("id").alias("dst"), F.col("community").alias("q"))
    e = edges.join(a, "src").join(b, "dst")
    inside = e.agg(F.sum("weight").alias("m"), F.coalesce(F.sum(F.when(F.col("p") == F.col("q"), F.col("weight"))), F.lit(0.0)).alias("in"))
    strength = both_ways(edges).join(a, "src").groupBy("p").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return inside.crossJoin(strength).select((F.col("in") / F.col("m") - resolution * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def coarsen(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG-11: weights summed between communities."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("p")), labels.select(F.col("id").alias("dst"), F.col("community").alias("q"))
    e = edges.join(a, "src").join(b, "dst").where("p <> q")
    return e.groupBy(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).agg(F.sum("weight").alias("weight"))


def communities(edges: DataFrame, vertices: DataFrame, resolution: float | None = 1.0, smallest: int = 3, levels: int = 5, rounds: int = 12) -> DataFrame:
    """GRF-11, GRF-13, GRF-14: (level, id, community, parent): a hierarchy of communities by moves that raise modularity, with a
    refinement before each coarsening, the same way at every size. Every community hangs together. Communities of fewer than `smallest` members join the neighbour they share most weight with. Levels
    stop when the partition no longer changes. Without a resolution, the best of some is taken (GRF-12) for a graph of up to
    SWEPT vertices, else 1, as is the sweep's definition."""
    edges, vertices = numbered(edges, vertices)
    n = vertices.count()
    if resolution is None:
        resolution = best_resolution(edges, vertices, rounds=rounds) if n <= SWEPT else 1.0
    of, level_edges, level_nodes = [], edges, vertices.select("id", "turns")
    for level in range(levels):
        size = n if level == 0 else level_nodes.count()
        if size < 2 and level:
            break
        labels = moved(level_edges, level_nodes, resolution, rounds)
        if level == 0:
            labels = merge_small(level_edges, refined(level_edges, level_nodes, labels, resolution), smallest)
        else:
            labels = cut(hanging_together(level_edges, labels))
        named = cut(level_nodes.join(labels.select(F.col("community").alias("id")).distinct(), "id", "left_semi"))
        parts = named.count()
        if level and not 1 < parts < size:
            break
        of.append(labels.select(F.col("id").alias(f"c{level - 1}"), F.col("community").alias(f"c{level}")))
        # A community's inner weight goes on as a loop, so that the strength of its vertex stays right.
        level_edges, level_nodes = cut(_inner(level_edges, labels)), named
        if parts < 2:
            break
    # A community is named after a member, so all names are among those of level 0. What is over a community is joined to it once.
    names = cut(vertices.join(of[0].select(F.col("c0").alias("id")).distinct(), "id", "left_semi").select("id", "name"))
    over = names.select(F.col("id").alias("c0"), F.col("name").alias("n0"))
    for level in range(1, len(of)):
        over = over.join(of[level], f"c{level - 1}").join(names.select(F.col("id").alias(f"c{level}"), F.col("name").alias(f"n{level}")), f"c{level}")
    over = over.select("c0", F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"n{level}").alias("community"), (F.col(f"n{level + 1}") if level + 1 < len(of) else F.lit(None).cast(names.schema["name"].dataType)).alias("parent")) for level in range(len(of))]).alias("x"))
    rows = vertices.select(F.col("id").alias("c-1"), F.col("name").alias("id")).join(of[0], "c-1").join(cut(over), "c0").select("id", F.explode("x").alias("x"))
    return rows.select("x.level", "id", "x.community", "x.parent")


def _inner(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Weights between and inside communities."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("p")), labels.select(F.col("id").alias("dst"), F.col("community").alias("q"))
    e = edges.join(a, "src").join(b, "dst")
    return e.groupBy(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).agg(F.sum("weight").alias("weight"))


def hanging_together(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(id, community) with communities that fall apart parted into their components, named after their smallest members. That
    never lowers modularity: no weight inside is lost, and the strengths are split."""
    return components(_within(edges, labels), labels).select("id", F.col("component").alias("community"))


def _within(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges whose ends share a community."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("p")), labels.select(F.col("id").alias("dst"), F.col("community").alias("q"))
    return edges.join(a, "src").join(b, "dst").where("p = q").select("src", "dst", "weight")


def _strengths(edges: DataFrame) -> DataFrame:
    """(id, k): the weights at each vertex, loops twice."""
    ends = F.explode(F.array("src", "dst")).alias("id")
    return edges.select(ends, "weight").groupBy("id").agg(F.sum("weight").alias("k"))


def _turns():
    """A bit for each of TURNS rounds: whether the vertex sits it out."""
    bits = [F.shiftleft(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)), r) for r in range(TURNS)]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), bits)


def _dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """df in so many parts by key; where one is enough, without a shuffle."""
    return df.repartition(parts, key) if parts > 1 else df.coalesce(1)


def numbered(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges by numbers and vertices(id, turns, name): numbers in the order of the names, which stand for them in loops. An end
    that is no vertex is null, so that it has a weight and no place."""
    v = cut(vertices.select(F.col("id").alias("name"), _turns().alias("turns")).orderBy("name").select(F.monotonically_increasing_id().alias("id"), "turns", "name"))
    a, b = (v.select(F.col("name").alias(c), F.col("id").alias(x)) for c, x in (("src", "a"), ("dst", "b")))
    return cut(edges.join(a, "src", "left").join(b, "dst", "left").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")), v


def falling_apart(edges: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(level, community) of those in hierarchy(level, id, community, parent) that are several components. A level is tested on
    what hangs together of the one below, which lies whole in its communities."""
    zero = hierarchy.where("level = 0")
    e, v = numbered(edges, zero.select("id"))
    labels, out = cut(v.join(zero.selectExpr("id AS name", "community"), "name").select("id", "community")), None
    for level in range((hierarchy.agg(F.max("level")).first()[0] or 0) + 1):
        if level:
            up = hierarchy.where(F.col("level") == level - 1).select("community", "parent").distinct()
            labels = cut(nodes.join(up, "community").selectExpr("id", "parent AS community"))
        parts = cut(hanging_together(e, labels).withColumnRenamed("community", "part").join(labels, "id"))
        nodes = cut(parts.selectExpr("part AS id", "community").distinct())
        apart = nodes.groupBy("community").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(level).alias("level"), "community")
        out = apart if out is None else out.union(apart)
        e = cut(coarsen(e, parts.selectExpr("id", "part AS community")))
    return out


def refined(edges: DataFrame, vertices: DataFrame, labels: DataFrame, resolution: float = 1.0, rounds: int = 4) -> DataFrame:
    """The refinement phase: inside each community, vertices start alone again and join only neighbours in it, by the gain that the
    whole graph gives; what hangs together then moves as one vertex between the communities of labels. So a part that a community
    took in early can leave it whole, which single vertices can't. The better of both partitions is kept; its communities hang
    together."""
    parts = cut(hanging_together(edges, moved(cut(_within(edges, labels)), vertices, resolution, rounds, strength=_strengths(edges))))
    start = parts.join(labels.withColumnRenamed("community", "start"), "id").groupBy(F.col("community").alias("id")).agg(F.min("start").alias("community"))
    name = start.groupBy("community").agg(F.min("id").alias("name"))  # a community is named after a vertex of the coarse graph
    start = cut(start.join(name, "community").select("id", F.col("name").alias("community")))
    between = cut(_inner(edges, parts))
    coarse = hanging_together(between, moved(between, vertices.join(start.select("id"), "id", "left_semi"), resolution, rounds, start=start))  # parts hang together, so theirs do
    new = cut(parts.select("id", F.col("community").alias("part")).join(coarse.select(F.col("id").alias("part"), "community"), "part").select("id", "community"))
    before, after = ((modularity(edges, x, resolution).first() or [0.0])[0] or 0.0 for x in (labels, new))
    return new if after >= before else cut(hanging_together(edges, labels))


def moved(edges: DataFrame, vertices: DataFrame, resolution: float = 1.0, rounds: int = 12, strength: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """(id, community): each vertex starts alone, or where start(id, community) says, in a community named after a vertex; in each round half of them, by a hash, go to the neighbouring community that
    raises modularity most, if any does. Two rounds in which a thousandth of the vertices at most moves end it, or so many rounds.
    Loops count in strengths only; strength(id, k): the vertices' strengths, where edges aren't all that they have. vertices may
    hold their turns, as numbered() gives them. A community is named after its smallest member."""
    turns = vertices if "turns" in vertices.columns else vertices.select("id", _turns().alias("turns"))
    strength = _strengths(edges) if strength is None else strength
    own = vertices.selectExpr("id", "id AS community") if start is None else start.select("id", "community")
    labels = cut(own.join(strength, "id", "left").selectExpr("id", "community", "coalesce(k, 0D) AS k"))
    sums = labels.agg(F.sum("k"), F.count("*")).first()
    m2, parts = float(sums[0] or 1.0), (2 * edges.count() + sums[1]) // EDGES_A_TASK + 1
    # The edges stay where the vertices at their ends are, in memory or on local disks, for all rounds; only labels travel.
    e = _dealt(both_ways(edges.where("src <> dst")).join(turns.selectExpr("id AS src", "turns"), "src"), parts, "dst").sortWithinPartitions("dst").persist()
    still = 0
    for r in range(rounds):
        at = labels.coalesce(1) if parts == 1 else labels
        mass = at.groupBy("community").agg(F.sum("k").alias("mass"), F.count("*").alias("size"))
        # One array, so that both uses below read the same columns and share one shuffle.
        now = _dealt(at.join(mass.hint("merge") if parts == 1 else mass, "community").selectExpr("id", "community", "array(k, mass, double(size)) AS s"), parts, "id")
        active = e.where(f"shiftright(turns, {r % TURNS}) & 1 = 0")
        told = active.join(now.selectExpr("id AS dst", "community", "s").hint("merge"), "dst").selectExpr("src", "community", "weight", "s[1] AS mass", "s[2] AS size")
        around = _dealt(told, parts, "src").groupBy("src", "community").agg(F.sum("weight").alias("w"), F.max("mass").alias("mass"), F.max("size").alias("size"))
        each = now.selectExpr("id", "community AS own", "s[0] AS k", "s[1] AS m", "s[2] AS n").join(around.withColumnRenamed("src", "id").hint("merge"), "id", "left")
        # A vertex that is alone joins another that is alone only if that has the smaller name, so that two don't change places.
        open_ = "community <> own AND NOT (n = 1 AND size = 1 AND community > own)"
        option = f"struct(-round(w - {float(resolution)!r}D * k * mass / {m2!r}D, 9) AS g, 1 AS o, community)"
        best = each.groupBy("id").agg(*[F.expr(f"first({c}) AS {c}") for c in ("own", "k", "m", "n")], F.expr("coalesce(max(w) FILTER (WHERE community = own), 0D) AS w"), F.expr(f"min({option}) FILTER (WHERE {open_}) AS best"))
        stay = f"struct(-round(w - {float(resolution)!r}D * k * (m - k) / {m2!r}D, 9) AS g, 0 AS o, own AS community)"
        new = cut(best.selectExpr("id", "own", f"CASE WHEN best < {stay} THEN best.community ELSE own END AS community", "k"))
        went = new.selectExpr("count_if(community <> own) AS went", "count(*) AS n").first()
        still = still + 1 if went.went * 1000 <= went.n else 0
        labels = new.drop("own")
        if still == 2:
            break
    name = labels.groupBy("community").agg(F.min("id").alias("name"))
    out = cut(labels.join(name, "community").selectExpr("id", "name AS community"))
    e.unpersist()
    return out


def merge_small(edges: DataFrame, labels: DataFrame, smallest: int) -> DataFrame:
    """GRF-13: communities of fewer than `smallest` members join the neighbour they share most weight with (the smallest name on
    a tie), again and again; those without neighbours stay."""
    while smallest > 1:
        size = labels.groupBy("community").agg(F.count("*").alias("size"))
        between = coarsen(edges, labels)
        near = both_ways(between).join(size.where(F.col("size") < smallest).select(F.col("community").alias("src")), "src")
        to = cut(near.groupBy("src").agg(F.min_by("dst", F.struct((-F.col("weight")).alias("w"), "dst")).alias("dst")))
        if to.isEmpty():
            break
        one = components(to.select("src", "dst"), size.select(F.col("community").alias("id")))
        labels = cut(labels.join(one.select(F.col("id").alias("community"), "component"), "community").select("id", F.col("component").alias("community")))
    return labels


def best_resolution(edges: DataFrame, vertices: DataFrame, candidates=(0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0), rounds: int = 12) -> float:
    """GRF-12: the resolution whose partition has two parts or more and the highest modularity."""
    found = []
    for r in candidates:
        labels = moved(edges, vertices, r, rounds)
        if labels.select("community").distinct().count() >= 2:
            found.append((modularity(edges, labels).first()[0] or 0.0, -r))
    return -max(found)[1] if found else 1.0


def with_community(vertices: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """GRF-17: vertices with their community of level 0."""
    return vertices.join(hierarchy.where("level = 0").select("id", "community"), "id", "left")


def community_records(labels: DataFrame, edges: DataFrame, entities: DataFrame, level: int = 0) -> DataFrame:
    """AGG-12, AGG-13, AGG-14, GRF-16: of labels(id, community): size, inner edges, density, text units and rank, the sum of
    the members' degrees. entities: id, text_unit_ids."""
    inside = edges.join(labels.select(F.col("id").alias("src"), F.col("community").alias("p")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("q")), "dst")
    inside = inside.where("p = q").groupBy(F.col("p").alias("community")).agg(F.count("*").alias("edges"))
    deg = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    m = labels.join(deg, "id", "left").groupBy("community").agg(F.count("*").alias("size"), F.coalesce(F.sum("degree"), F.lit(0)).alias("rank"))
    units = labels.join(entities.select("id", F.explode("text_unit_ids").alias("u")), "id").groupBy("community").agg(F.countDistinct("u").alias("text_units"))
    j = m.join(inside, "community", "left").join(units, "community", "left")
    e, n = F.coalesce("edges", F.lit(0)), F.col("size")
    return j.select("community", "size", e.alias("edges"), F.when(n > 1, 2.0 * e / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"), F.coalesce("text_units", F.lit(0)).alias("text_units"), "rank")
