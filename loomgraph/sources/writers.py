"""Versioned tables: every write is a new folder, and a manifest that is written last says which folders count (§2.2)."""

from __future__ import annotations

import json
import time
import uuid

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.identity import check_suffix

_BUCKET = "__bucket"
#: How often a change is tried when others write the table too.
TRIES = 8
#: Keys that a lookup lists for the scan at most; more are joined.
LISTED = 2000


class Conflict(OSError):
    """Another writer came first."""


class Store:
    """Tables of one tenant under a root folder, on any file system that Spark reads.

    Rows lie in buckets by a hash of the table's key. A manifest is a small file with a number: which folder each bucket is
    read from, the key and the schema. The one with the greatest number counts; a new one is written beside it before
    anything goes, so a write that breaks off leaves the table as it was. Upserts and deletes by the key write only the
    buckets that they touch.

    A change remembers the number that it began with, and counts only as the next one: of two writers at once the second finds
    that number taken, and does its work again on what the first left. A writer removes the folders that a manifest it drops
    named, and no others. (A rename onto a manifest that is there must fail, as it does on HDFS and local file systems.)

    How many buckets a table has follows from its bytes, about `target` each: a table that has outgrown them twice over is parted
    anew when it is written.
    """

    def __init__(self, spark: SparkSession, root: str, suffix: str = "default", buckets: int = 16, target: int = 128 << 20):
        self.spark, self.root, self.buckets, self.target = spark, f"{root}/{check_suffix(suffix)}", buckets, target
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self.fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        found = self.fs.globStatus(self._path(f"{self.root}/{name}.manifest-*")) or []
        return sorted(int(s.getPath().getName().rsplit("-", 1)[1]) for s in found)

    def _load(self, name: str, number: int) -> dict:
        stream = self.fs.open(self._path(f"{self.root}/{name}.manifest-{number:09d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self, name: str) -> dict | None:
        numbers = self._numbers(name)
        return self._load(name, numbers[-1]) if numbers else None

    def _last(self, name: str) -> int:
        return max(self._numbers(name), default=0)

    def _point(self, name: str, manifest: dict, keep: int, base: int) -> None:
        """Writes manifest base + 1, or raises Conflict if there is one; then drops those before the last `keep`, and the folders
        that only they named."""
        numbers = self._numbers(name)
        new, at = self._path(f"{self.root}/{name}.next-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}.manifest-{base + 1:09d}")
        out = self.fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if max(numbers, default=0) != base or self.fs.exists(at) or not self.fs.rename(new, at):
            self.fs.delete(new, False)
            raise Conflict(f"{name}: another write came first")
        stays = numbers[len(numbers) - keep :] if keep else []
        named = {v for m in [manifest, *(self._load(name, n) for n in stays)] for v in m["folders"].values()}
        for n in numbers[: len(numbers) - len(stays)]:
            gone = set(self._load(name, n)["folders"].values()) - named
            self.fs.delete(self._path(f"{self.root}/{name}.manifest-{n:09d}"), False)
            for v in gone:
                self.fs.delete(self._path(f"{self.root}/{name}/{v}"), True)

    def _bytes(self, name: str, folders: dict[str, str]) -> int:
        return sum(self.fs.getContentSummary(self._path(f"{self.root}/{name}/{v}")).getLength() for v in set(folders.values()))

    def _drop(self, name: str, folders: dict[str, str]) -> None:
        for v in set(folders.values()):
            self.fs.delete(self._path(f"{self.root}/{name}/{v}"), True)

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def _of(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def _rows(self, name: str, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        at = [f"{self.root}/{name}/{v}/{_BUCKET}={b}" for b, v in manifest["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        manifest = self._manifest(name)
        if manifest is None:
            raise FileNotFoundError(name)
        return self._rows(name, manifest)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows whose key is among keys, one column. Of up to LISTED keys, only their buckets are read, and row groups that may
        hold them, as rows are sorted by key there."""
        m = self._manifest(name)
        if m is None:
            raise FileNotFoundError(name)
        key, (own,) = m["key"], keys.columns
        listed = keys.select(F.col(own).alias(key)).distinct().select(key, self._of(key, m["buckets"])).limit(LISTED + 1).collect()
        if len(listed) > LISTED:
            return self._rows(name, m).join(keys.select(F.col(own).alias(key)).distinct(), key, "left_semi")
        return self._rows(name, m, {str(r[1]) for r in listed}).where(F.col(key).isin([r[0] for r in listed]))

    def _write(self, name: str, df: DataFrame, key: str, buckets: int, then=None) -> dict[str, str]:
        """A folder with df's rows by bucket; which bucket is in it. then: what is made of df's columns once rows are in place."""
        version = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        at = self._path(f"{self.root}/{name}/{version}")
        try:
            rows = df.withColumn(_BUCKET, self._of(key, buckets)).hint("rebalance", _BUCKET).sortWithinPartitions(_BUCKET, key)
            (then(rows) if then else rows).write.partitionBy(_BUCKET).parquet(at.toString())
        except Exception:
            self.fs.delete(at, True)
            raise
        found = (s.getPath().getName() for s in self.fs.listStatus(at))
        return {f.split("=")[1]: version for f in found if f.startswith(_BUCKET)}

    def _fitted(self, name: str, df: DataFrame, key: str, buckets: int, then=None) -> tuple[dict[str, str], int]:
        """df, written; with more buckets if these turn out too large for them."""
        folders = self._write(name, df, key, buckets, then)
        if (wanted := -(-self._bytes(name, folders) // self.target)) <= 2 * buckets:
            return folders, buckets
        rows = self._rows(name, {"schema": json.loads((then(df) if then else df).schema.json()), "folders": folders})
        again = self._write(name, rows, key, wanted)
        self._drop(name, folders)
        return again, wanted

    def replace(self, name: str, df: DataFrame, key: str | None = None, keep: int = 1, then=None, **notes) -> int:
        """SNK-1, SNK-4: the new version is written in full, then counts, then older ones but `keep` go. A failed write leaves
        the table as it was; of two at once the later one stays. then: what is made of df's columns, but the key, after the shuffle
        to the buckets. notes: what else the manifest says. Returns the rows."""
        key = key or next((c for c in ("id", "doc_id") if c in df.columns), df.columns[0])
        old = self._manifest(name)
        folders, buckets = self._fitted(name, df, key, old["buckets"] if old else self.buckets, then)
        manifest = {"key": key, "buckets": buckets, "folders": folders, "schema": json.loads((then(df) if then else df).schema.json())} | notes
        for _ in range(TRIES):
            try:
                self._point(name, manifest, keep, self._last(name))
                return self._rows(name, manifest).count()
            except Conflict:
                continue
        self._drop(name, folders)
        raise Conflict(name)

    def _change(self, name: str, keys: DataFrame, more: DataFrame | None, key: str, keep: int) -> int:
        """Without the rows whose key is in keys(key), and with more; on what another writer left, if one comes first."""
        for _ in range(TRIES):
            base = self._last(name)
            m = self._load(name, base)
            by_key = m["key"] == key  # else the buckets don't tell where the keys are
            touched = {str(r[0]) for r in keys.select(self._of(key, m["buckets"])).distinct().collect()} if by_key else set(m["folders"])  # as many as there are buckets at most
            old = self._rows(name, m, touched)
            rest = old.join(keys, key, "left_anti").select(old.columns)
            rest = rest if more is None else rest.unionByName(more, allowMissingColumns=True)
            schema = json.loads(T.StructType([*rest.schema.fields]).json())
            new = self._write(name, rest, m["key"], m["buckets"])
            folders = {b: v for b, v in m["folders"].items() if b not in touched} | new
            try:
                self._point(name, m | {"folders": folders, "schema": schema}, keep, base)
            except Conflict:
                self._drop(name, new)
                continue
            rows = self._rows(name, {"folders": folders, "schema": schema})
            if self._bytes(name, folders) > 4 * self.target * m["buckets"]:
                return self.replace(name, rows, m["key"], keep)
            return rows.count()
        raise Conflict(name)

    def upsert(self, name: str, df: DataFrame, key: str = "id", keep: int = 1) -> int:
        """SNK-2, SNK-5, SNK-6, SNK-11: rows of df take the place of those with their keys."""
        if not self.exists(name):
            return self.replace(name, df, key, keep)
        return self._change(name, df.select(key).distinct(), df, key, keep)

    def delete(self, name: str, ids: DataFrame, key: str = "id", keep: int = 1) -> int:
        """SNK-3, SNK-8: without the rows whose keys are among ids(id)."""
        return self._change(name, ids.select(F.col("id").alias(key)).distinct(), None, key, keep)

    def clear(self, names: list[str] | None = None) -> None:
        """SNK-20, SNK-22: drops tables, by default all, the registry with them."""
        for n in self.names() if names is None else names:
            for number in self._numbers(n):
                self.fs.delete(self._path(f"{self.root}/{n}.manifest-{number:09d}"), False)
            self.fs.delete(self._path(f"{self.root}/{n}"), True)

    def names(self) -> list[str]:
        found = self.fs.globStatus(self._path(f"{self.root}/*.manifest-*")) or []
        return sorted({s.getPath().getName().rsplit(".manifest-", 1)[0] for s in found})

    def write_all(self, phases: list[dict[str, DataFrame]]) -> dict[str, int]:
        """SNK-10: tables phase by phase, so that what others point to is there first; those of one phase at the same time."""
        from concurrent.futures import ThreadPoolExecutor

        done: dict[str, int] = {}
        for phase in phases:
            with ThreadPoolExecutor(max(1, len(phase))) as pool:
                jobs = {n: pool.submit(self.replace, n, df) for n, df in phase.items()}
                done |= {n: j.result() for n, j in jobs.items()}
        return done

    def counts(self) -> dict[str, int]:
        return {n: self.read(n).count() for n in self.names()}

    def verify(self, expected: list[str]) -> list[str]:
        """INC-9b: tables that should be there and are not."""
        return [n for n in expected if not self.exists(n)]


def edges_with_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """SNK-6: only edges whose two vertices exist are written."""
    from loomgraph.operators.relational import without_orphans

    return without_orphans(edges, vertices)


def memberships(communities: DataFrame) -> DataFrame:
    """SNK-7: (community_id, entity_id)."""
    return communities.select(F.col("id").alias("community_id"), F.explode("entity_ids").alias("entity_id")).distinct()


def incident(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """SNK-9: ids of edges that touch vertices(id)."""
    a = edges.join(vertices.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id")
    return a.union(edges.join(vertices.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("id")).distinct()


def filter_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-13: attr_ columns of the map filters."""
    return df.select("*", *[F.col("filters").getItem(k).alias(f"attr_{k}") for k in keys])


def truncated(df: DataFrame, most: int = 1000) -> DataFrame:
    """SNK-14: strings cut, maps and structs as JSON."""
    kind = dict(df.dtypes)
    one = lambda c: F.left(c, F.lit(most)) if kind[c] == "string" else F.left(F.to_json(c), F.lit(most)) if kind[c].startswith(("map", "struct")) else F.col(c)
    return df.select(*[one(c).alias(c) for c in df.columns])


def gate(results: dict[str, tuple[int, int]], most: float = 0.2) -> list[str]:
    """SNK-12: kinds of rows of which none, or too few, of what was to be written (done, failed) was."""
    return [k for k, (done, failed) in results.items() if done + failed and (done == 0 or failed / (done + failed) > most)]


def contract(name: str, inputs: int, outputs: int, must: bool, incremental: bool = False) -> None:
    """SNK-21."""
    if must and not incremental and (inputs == 0 or outputs == 0):
        raise ValueError(f"{name}: {inputs} rows in, {outputs} out")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK-19: nodes and edges as lines of JSON, in folders beside each other."""
    nodes.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/nodes")
    edges.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/edges")


def log_metrics(metrics: dict) -> str:
    """SNK-17: a line of JSON; flags are no metrics."""
    return json.dumps({k: v for k, v in sorted(metrics.items()) if isinstance(v, (int, float)) and not isinstance(v, bool)})


def export_results(results: DataFrame, folder: str, name: str, at: str) -> str:
    """SNK-18: results as lines of JSON in a folder of their own, named after what they are and when."""
    path = f"{folder}/{name}-{at}"
    results.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


class Cache:
    """SNK-15, SNK-16: stages' results by name and content hash, with a time to live; any path that Spark reads is shared by all
    who use it, so nothing needs to be carried to and fro."""

    def __init__(self, store: Store, hours: float = 24.0):
        self.store, self.hours, self.hits, self.misses = store, hours, 0, 0

    def get(self, name: str, content: str, build, now: float | None = None) -> DataFrame:
        """The stored result of `name` if it was built from the same content and is young enough, else build()'s, stored."""
        now, entry = time.time() if now is None else now, f"cache_{name}"
        if self.store.exists(entry):
            m = self.store._manifest(entry)
            if m.get("content") == content and now - m.get("at", 0) <= self.hours * 3600:
                self.hits += 1
                return self.store.read(entry)
        self.misses += 1
        df = build()
        self.store.replace(entry, df, content=content, at=now)
        return self.store.read(entry)

    def statistics(self) -> dict[str, float]:
        total = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "hit_rate": self.hits / total if total else 0.0}


def files(rows: DataFrame, folder: str) -> int:
    """rows(path, content) as one file each below a folder that all executors share; how many. Paths must be distinct: a task
    that runs again writes its files again."""

    def run(batches):
        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                at = f"{root}/{path}"
                try:
                    out = fs.open_output_stream(at)
                except FileNotFoundError:
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(at)
                with out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
