"""The public API: Engine(spark, folder).ingest(documents), .search(strategy, queries), .update(documents), .evaluate(...)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.identity import text_unit_id
from loomgraph.functions.text import normalize_name
from loomgraph.operators import graph as G
from loomgraph.operators import retrieval as R
from loomgraph.operators.relational import grounding_gate, merge_claims, merge_incremental, merge_resolved_edges, remap_edges, without_orphans
from loomgraph.operators.similarity import best_match
from loomgraph.plans.chunking import chunk
from loomgraph.plans.extract import Models, grounded
from loomgraph.plans.reports import bottom_up
from loomgraph.plans.strategies import TEXTS, search
from loomgraph.sources.inverted import InvertedIndex
from loomgraph.sources.writers import Store
from loomgraph.streaming import incremental as I

STAGES = ("text_units", "entities", "edges", "claims", "communities", "reports", "vectors", "indexes")
#: SNK-10: what is written at the same time; a phase's tables point to those of the phases before.
PHASES = (("text_units",), ("entities", "edges"), ("claims", "communities"), ("reports",), ("vectors",), ("indexes",))
#: The tables that have vectors, and the column that is embedded.
EMBEDDED = {"text_units": "text", "entities": "name", "reports": "full_content"}


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight")


def _without(artifacts: DataFrame, units: DataFrame) -> DataFrame:
    """artifacts without the text units(id) that go; those that lose all go themselves (INC-3)."""
    each = artifacts.select("id", F.explode("text_unit_ids").alias("unit")).join(units.select(F.col("id").alias("unit")), "unit", "left_anti")
    kept = each.groupBy("id").agg(F.array_sort(F.collect_set("unit")).alias("text_unit_ids"))
    return artifacts.drop("text_unit_ids").join(kept, "id").select(artifacts.columns)


class Engine:
    """One tenant's tables in a folder, and the plans over them.

    claims: whether claims are extracted (FLT-10). gleanings: further passes of extraction. grounding: None, or what the
    confidence of an entity whose name its text units don't hold is multiplied with (0: it goes). resolution: of communities;
    None takes the best (GRF-12). levels: of communities, at most. similar: the likeness from which names of two runs are one entity (SIM-9; None: equal names).
    """

    def __init__(self, spark: SparkSession, folder: str, suffix: str = "default", models: Models | None = None, claims: bool = True, gleanings: int = 0, grounding: float | None = None, resolution: float | None = 1.0, similar: float | None = None, levels: int = 5):
        self.spark, self.store, self.models = spark, Store(spark, folder, suffix), models or Models()
        self.with_claims, self.gleanings, self.grounding, self.resolution, self.similar, self.levels = claims, gleanings, grounding, resolution, similar, levels
        self.metrics: dict[str, dict[str, float]] = {}
        self._both: tuple[DataFrame, DataFrame] | None = None
        self._left: set[str] = set()

    text_units = property(lambda self: self.store.read("text_units"))
    entities = property(lambda self: self.store.read("entities"))
    edges = property(lambda self: self.store.read("edges"))
    claims = property(lambda self: self.store.read("claims"))
    reports = property(lambda self: self.store.read("reports"))

    @property
    def has_claims(self) -> bool:
        return self.with_claims and self.store.exists("claims")

    def vectors(self, kind: str) -> DataFrame | None:
        return self.store.read("vectors").where(F.col("kind") == kind).select("id", "embedding") if self.store.exists("vectors") else None

    def index(self, kind: str) -> InvertedIndex | None:
        """SCR-1: the stored index of a kind of rows, if there is one."""
        found = InvertedIndex(self.store, f"words.{kind}")
        return found if found.exists else None

    @property
    def labels(self) -> DataFrame:
        return self.store.read("communities").where("level = 0").select("id", "community")

    @property
    def members(self) -> DataFrame:
        """(level, community_id, id) of all levels."""
        return self.store.read("communities").select("level", F.col("community").alias("community_id"), "id")

    @property
    def relation_names(self) -> DataFrame:
        n = self.entities.select("id", "name")
        e = self.edges.join(n.select(F.col("id").alias("source_id"), F.col("name").alias("s")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id")
        return e.select("id", F.concat_ws(" ", "s", "t").alias("name"))

    def ingest(self, docs: DataFrame, resume: bool = False, start: str | None = None, leave: tuple[str, ...] = ()) -> dict[str, int]:
        """Documents (doc_id, text) to all tables, stage by stage; with resume, stages that are there are kept; start: the stage
        to begin with, whose predecessors must be there (INC-9). leave: stages to leave out, for searches that don't read their
        tables; a further run that starts with the first of them makes up for them,
        and vectors and indexes take the new tables in. "indexes.KIND" leaves the index of one kind of rows out, which index_also() builds."""
        self._left = set(leave)
        done = [s for s in STAGES if (resume or start) and (s in leave or self.store.exists(s))]
        if resume and "indexes" in done and not self._indexed().issuperset(self._kinds()):
            done.remove("indexes")
        todo = I.resume(done, list(STAGES), start)
        if start and (lacking := self.store.verify([s for s in STAGES[: STAGES.index(start)] if s not in leave and (s != "claims" or self.with_claims)])):
            raise ValueError(f"{start} needs {lacking}")
        self._both = None
        for s in todo:
            if s not in leave and (s != "claims" or self.with_claims):
                self._run(s, getattr(self, f"_{s}"), docs)
        self._both = None
        self.store.replace("doc_status", I.registry(docs).withColumn("status", F.lit("processed")))
        return {n: self.store.read(n).count() for n in self.store.names() if "." not in n}

    def _run(self, stage: str, build, *args) -> None:
        """AGG-20: writes a stage's table and notes its rows, seconds and rows a second."""
        began = time.time()
        rows = self.store.replace(stage, build(*args))
        took = time.time() - began
        self.metrics[stage] = {"rows": rows, "seconds": took, "rows_a_second": rows / took if took else 0.0}

    def _units(self, docs: DataFrame) -> DataFrame:
        units = self.models.translate(chunk(docs))
        return units.select(text_unit_id(F.col("document_id"), F.col("number")).alias("id"), "document_id", "number", "text")

    def _extracted(self, units: DataFrame) -> tuple[DataFrame, DataFrame]:
        """LLM-1..4: entities and edges of text units, with further passes, gate and shortened descriptions as they are set."""
        ents, edges = self.models.extract(units)
        if self.gleanings:
            ents, edges = self.models.glean(units, ents, edges, self.gleanings)
        if self.grounding is not None:
            ok = grounded(ents, units).select("id", F.lit(True).alias("ok"))
            gated = grounding_gate(ents.join(ok, "id", "left"), F.coalesce("ok", F.lit(False)), penalty=self.grounding or None)
            ents = gated.select(ents.columns)
            edges = without_orphans(edges, ents)
        return self.models.summarise(ents), edges

    def _text_units(self, docs: DataFrame) -> DataFrame:
        return self._units(docs)

    def _once(self) -> tuple[DataFrame, DataFrame]:
        """Entities and edges of all text units, extracted once for both stages."""
        if self._both is None:
            ents, edges = self._extracted(self.text_units)
            self._both = G.cut(ents), G.cut(edges)
        return self._both

    def _entities(self, docs: DataFrame) -> DataFrame:
        return self._once()[0]

    def _edges(self, docs: DataFrame) -> DataFrame:
        return self._once()[1]

    def _claims(self, docs: DataFrame | None = None) -> DataFrame:
        return merge_claims(self.models.claims(self.text_units, self.entities))

    def _communities(self, docs: DataFrame | None = None) -> DataFrame:
        return G.communities(G.simple(_ends(self.edges)), self.entities.select("id"), self.resolution, levels=self.levels)

    def _reports(self, docs: DataFrame | None = None) -> DataFrame:
        return bottom_up(self.store.read("communities"), self.edges, self.entities, self.models.report)

    def _texts(self, kind: str) -> DataFrame:
        return getattr(self, kind).select("id", F.col(TEXTS[kind]).alias("text"))

    def _kinds(self) -> list[str]:
        """The kinds of rows that are to have an index."""
        return [k for k in TEXTS if f"indexes.{k}" not in self._left and (k == "relation_names" or self.store.exists(k) and (k != "claims" or self.has_claims))]

    def _indexed(self) -> set[str]:
        return {r[0] for r in self.store.read("indexes").select("kind").collect()}  # a row for each kind

    def index_also(self, kinds: tuple[str, ...]) -> None:
        """Builds indexes that an ingest left out; the others stay."""
        self._left -= {f"indexes.{k}" for k in kinds}
        for kind in kinds:
            InvertedIndex(self.store, f"words.{kind}").build(G.cut(self._texts(kind)))
        self.store.replace("indexes", self.spark.createDataFrame([(k,) for k in sorted(self._indexed().union(kinds))], "kind string"))

    def _indexes(self, before: dict[str, DataFrame] | None = None) -> DataFrame:
        """SCR-1: the stored indexes, anew, or what became other since `before`(id, text)."""
        kinds = self._kinds()
        for kind in kinds:
            index, now = InvertedIndex(self.store, f"words.{kind}"), G.cut(self._texts(kind))
            old = before.get(kind) if isinstance(before, dict) else None
            if old is None or not index.exists:
                index.build(now)
                continue
            same = (F.col("a.id") == F.col("b.id")) & F.col("a.text").eqNullSafe(F.col("b.text"))
            gone, new = (G.cut(x.alias("a").join(y.alias("b"), same, "left_anti")) for x, y in ((old, now), (now, old)))
            if not gone.isEmpty():
                index.remove(gone)
            if not new.isEmpty():
                index.add(new)
        return self.spark.createDataFrame([(k,) for k in kinds], "kind string")

    def _vectors(self, docs: DataFrame | None = None) -> DataFrame:
        out = None
        for kind, text in EMBEDDED.items():
            if not self.store.exists(kind):  # left out
                continue
            part = self.models.embed(self.store.read(kind).select("id", F.col(text).alias("text")), "text").select(F.lit(kind).alias("kind"), "id", "embedding")
            out = part if out is None else out.union(part)
        return out

    def diff(self, docs: DataFrame) -> DataFrame:
        now = I.registry(docs)
        return I.diff(self.store.read("doc_status") if self.store.exists("doc_status") else now.limit(0), now)

    def update(self, docs: DataFrame) -> DataFrame:
        """INC-*, SNK-11: takes in what is new or changed among docs, the whole corpus, and removes what is gone. Entities and edges
        keep the text units of unchanged documents and gain those of the delta: ids of known entities stay (AGG-8), edges
        follow them (JN-4) and are weighed by the text units they have (AGG-9), and communities, reports, claims and vectors are
        built anew from the merged graph. Updating again changes nothing, and the tables are those of a full ingest."""
        changes = G.cut(self.diff(docs))
        if changes.where("change_type <> 'unchanged'").isEmpty():
            return changes
        before = {k: G.cut(self._texts(k)) for k in TEXTS if k != "claims" or self.has_claims}
        delta = G.cut(self._units(I.to_process(docs, changes)))
        ents, edges = self._extracted(delta)
        left = changes.where(F.col("change_type").isin("changed", "deleted")).select(F.col("doc_id").cast("string").alias("document_id"))
        gone = G.cut(self.text_units.join(left, "document_id", "left_semi").select("id"))
        old = G.cut(_without(self.entities, gone))
        merged, mapping = merge_incremental(old, self._known_names(ents, old), normalize_name("name"))
        merged, mapping = G.cut(merged), G.cut(mapping)
        kept = _without(self.edges, gone).withColumn("ord", F.lit(0))
        moved = remap_edges(edges, mapping).withColumn("ord", F.lit(1))
        both = without_orphans(kept.unionByName(moved, allowMissingColumns=True), merged)
        edges = G.cut(merge_resolved_edges(both.withColumn("ord", F.struct("ord", "id")), always=True))
        self.store.delete("text_units", gone)
        self.store.upsert("text_units", delta)
        self.store.replace("entities", merged.select(self.entities.columns))
        self.store.replace("edges", edges.select(self.edges.columns))
        for s in STAGES[3:]:
            if s != "claims" or self.with_claims:
                self._run(s, getattr(self, f"_{s}"), *([before] if s == "indexes" else []))
        self.store.replace("doc_status", I.registry(docs).withColumn("status", F.lit("processed")))
        return changes

    def _known_names(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """SIM-9: new entities under the name of the old one that theirs is like, where that is wanted."""
        if self.similar is None:
            return new
        match = best_match(new.select("name"), old.select("name"), self.similar).select("name", "match")
        return new.join(match, "name", "left").withColumn("name", F.coalesce("match", "name")).select(new.columns)

    def search(self, strategy: str, queries: DataFrame | list[str], top_k: int = 10, **options) -> DataFrame:
        if isinstance(queries, list):
            queries = self.spark.createDataFrame([(f"q_{i}", q) for i, q in enumerate(queries)], "query_id string, query string")
        return search(self, strategy, queries, top_k, **options)

    def answer(self, strategy: str, queries: list[str], budget: int = 4000, **options) -> DataFrame:
        """QRY-11: search, a context within a budget of tokens, and the answer of the model."""
        from loomgraph.functions.text import estimate_tokens

        q = self.spark.createDataFrame([(f"q_{i}", x) for i, x in enumerate(queries)], "query_id string, query string")
        s = self.search(strategy, q, **options)
        kind = F.when(F.startswith("source", F.lit("entity")), "ENTITY").when(F.startswith("source", F.lit("community")), "COMMUNITY").otherwise("TEXT")
        s = s.select("query_id", F.col("source").alias("key"), kind.alias("type"), "content", estimate_tokens("content").cast("long").alias("tokens"), R.section_priority(F.col("score"), kind).alias("priority"))
        return self.models.answer(q.join(R.context_text(R.pack(s, budget)), "query_id", "left"))
