"""A change feed of files, and tables kept equal to a full pass by keyed merges.

The feed is a file stream of events (path, kind, text; a null text is a
deletion).  Each micro-batch keeps the last event of a path, compares it with
the manifest by content hash, and merges what changed: rows of a changed file
are replaced, those of a deleted one removed.  Ids are hashes of names and
lines, so other files keep their rows; which of them refer elsewhere now is
worked out, and their references alone are resolved again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.rank import pagerank
from weftgraph.operators.resolve import imports, resolve
from weftgraph.operators.search import postings
from weftgraph.plans.index import symbols_of
from weftgraph.sources import code
from weftgraph.sources.tables import GraphTables, changes_since, delete_ids
from weftgraph.storage import cut
from weftgraph.streaming import maintain

EVENTS = "path string, kind string, text string, at long"


def last_events(batch: DataFrame) -> DataFrame:
    """One event per path: the latest, and of those of one moment a deletion last."""
    order = Window.partitionBy("path").orderBy(F.desc("at"), F.col("text").isNotNull())
    return batch.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


class LiveTables:
    """source, entity, symbol, raw_edge, import, edge, posting and rank tables of a set of files, and the state of maintenance."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, GraphTables(spark, root)

    def start(self) -> None:
        empty = self.spark.createDataFrame([], "path string, kind string, text string, hash string")
        self.tables.replace("source", empty)
        for name, rows in self._rows(empty).items():
            self.tables.replace(name, rows)
        symbols, raw = self.tables.read("symbol"), self.tables.read("raw_edge")
        self.tables.replace("import", imports(raw, empty))
        self.tables.replace("edge", self._edges(raw, symbols, empty))
        self.tables.replace("rank", self.spark.createDataFrame([], "id long, qname string, pagerank double"))
        self.tables.replace("state", self.spark.createDataFrame([], "changed long"))

    def _rows(self, files: DataFrame) -> dict[str, DataFrame]:
        found = cut(code.entities(files), "entities")
        posted = postings(files, "path", "text").withColumnRenamed("id", "path")
        return {"entity": found, "symbol": symbols_of(found).withColumn("path", F.col("file")), "raw_edge": code.raw_edges(files), "posting": posted}

    def _edges(self, raw: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
        """(path, rel, src, dst, line, confidence, method) of raw references; path: where they stand."""
        known = symbols.where("label <> 'Variable'")
        found = resolve(raw, known, files)
        return found.join(known.select(F.col("id").alias("src"), F.col("file").alias("path")), "src").select("path", "rel", "src", "dst", "line", "confidence", "method")

    def apply(self, batch: DataFrame, _batch_id: int = 0) -> None:
        """Merge one batch of events; a batch that is applied again changes nothing."""
        events = last_events(batch)
        read = self.tables.read
        old = read("source")
        gone = events.where("text IS NULL").select("path")
        new = events.where("text IS NOT NULL").select("path", "kind", "text", F.sha1(F.col("text").cast("binary")).alias("hash"))
        state = changes_since(old.select("path", "hash").join(events.select("path"), "path", "left_semi"), new.select("path", "hash"))
        touched = cut(state.where("state <> 'unchanged'").select("path").unionByName(gone).distinct(), "touched")
        n = touched.count()
        if not n:
            return
        fresh = cut(new.join(touched, "path", "left_semi"), "fresh")
        symbols, led = read("symbol"), read("import")
        for name, rows in self._rows(fresh).items():
            self.tables.replace(name, delete_ids(read(name), "path", touched).unionByName(rows))
        self.tables.replace("source", delete_ids(old, "path", touched).unionByName(fresh))
        files, raw = read("source"), read("raw_edge")
        self.tables.replace("import", imports(raw, files))
        scope = cut(maintain.to_resolve(touched, symbols, read("symbol"), raw, led, read("import")), "scope")
        # imports of other files take part in distances, so their records stay in what is resolved
        some = raw.join(scope, "path", "left_semi").unionByName(raw.where("rel IN ('IMPORTS', 'IMPORTS_SYMBOL')").join(scope, "path", "left_anti"))
        self.tables.replace("edge", delete_ids(read("edge"), "path", scope).unionByName(self._edges(some, read("symbol"), files)))
        self.tables.replace("state", read("state").unionByName(self.spark.createDataFrame([(n,)], "changed long")))

    def refresh_ranks(self) -> bool:
        """Ranks after passes: those of a global pass where drift() asks for one, else carried over; says which."""
        symbols, before = self.tables.read("symbol").where("label <> 'Variable'"), self.tables.read("rank")
        due = maintain.drift(self.tables.read("state"), self.tables.read("source").count(), symbols.count())
        if due:
            ranks = pagerank(symbols, self.tables.read("edge").where("rel IN ('CALLS', 'INHERITS', 'INSTANTIATES')"))
            self.tables.replace("state", self.spark.createDataFrame([], "changed long"))
        else:
            ranks = maintain.carry_ranks(symbols, before)
        self.tables.replace("rank", ranks.join(symbols.select("id", "qname"), "id").select("id", "qname", "pagerank"))
        return due

    def follow(self, folder: str, checkpoint: str, interval: str = "1 second") -> StreamingQuery:
        """Apply the JSON event files that arrive in folder."""
        stream = self.spark.readStream.schema(EVENTS).json(folder)
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(self.apply).start()

    def read(self, name: str) -> DataFrame:
        return self.tables.read(name)


def reuse_embeddings(chunks: DataFrame, known: DataFrame, embed) -> DataFrame:
    """(id, ehash, embedding): known vectors by content hash; only the others are embedded, once per content."""
    missing = chunks.select("ehash", "text").join(known.select("ehash"), "ehash", "left_anti").dropDuplicates(["ehash"])
    fresh = embed(missing).select("ehash", "embedding")
    return chunks.select("id", "ehash").join(known.select("ehash", "embedding").dropDuplicates(["ehash"]).unionByName(fresh), "ehash").select("id", "ehash", "embedding")


def activity(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by tumbling window; the same plan on a table and on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
