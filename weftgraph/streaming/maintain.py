"""What an incremental pass keeps, carries over or does anew.

A pass over a few files keeps ranks, communities and places of what it doesn't
touch, gives new symbols provisional ones, and asks drift() whether enough has
changed for a global pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from weftgraph.functions.geometry import hash01, spiral
from weftgraph.functions.text import name_norm
from weftgraph.storage import cut

#: Share of files that may change, and nodes under which everything is done anew.
DRIFT, SMALL = 0.05, 50_000


def carry_ranks(symbols: DataFrame, before: DataFrame) -> DataFrame:
    """(id, pagerank): the old rank by qualified name, 0 for new symbols; before: (qname, pagerank)."""
    old = before.groupBy("qname").agg(F.max("pagerank").alias("pagerank"))
    return symbols.select("id", "qname").join(old, "qname", "left").select("id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))


def carry_communities(symbols: DataFrame, before: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community): that of most members which the file had, else that of most neighbours which have one; others have none.

    before: (file, community, n) members by file.  Ties go to the smaller community.
    """
    pick = lambda n: F.min(F.struct((-F.col(n)).alias("n"), "community")).getField("community").alias("community")
    of_file = before.groupBy("file", "community").agg(F.sum("n").alias("n")).groupBy("file").agg(pick("n"))
    known = symbols.select("id", "file").join(of_file, "file").select("id", "community")
    open_ = symbols.select("id").join(known, "id", "left_anti")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    votes = both.join(open_.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(votes.groupBy("id").agg(pick("n")))


def carry_layout(symbols: DataFrame, before: DataFrame, rim: float) -> DataFrame:
    """(id, x, y): the symbols of a file on a spiral about its old centre; files without one go to the rim, where a hash of the path says.

    before: (file, x, y) centres.
    """
    i = F.row_number().over(Window.partitionBy("file").orderBy("id")) - 1
    dx, dy = spiral(F.col("_i"))
    nx, ny = place_new(F.col("file"), rim)
    rows = symbols.select("id", "file").withColumn("_i", i).join(before.select("file", F.col("x").alias("cx"), F.col("y").alias("cy")), "file", "left")
    return rows.select("id", (F.coalesce("cx", nx) + dx).alias("x"), (F.coalesce("cy", ny) + dy).alias("y"))


def place_new(file: Column, rim: float, anchor_x: Column | None = None, anchor_y: Column | None = None, near: float = 40.0) -> tuple[Column, Column]:
    """Where a new file goes: close to an anchor if it has one, else on the rim; the angle is a hash of its path."""
    angle = 2 * 3.141592653589793 * hash01(file)
    x, y = F.lit(rim) * F.cos(angle), F.lit(rim) * F.sin(angle)
    if anchor_x is not None:
        x = F.coalesce(anchor_x + F.lit(near) * F.cos(angle), x)
        y = F.coalesce(anchor_y + F.lit(near) * F.sin(angle), y)
    return x, y


def drift(state: DataFrame, files: int, nodes: int, limit: float = DRIFT, small: int = SMALL) -> bool:
    """Whether a global pass is due: the graph is small, or files changed since the last one (state: changed) are over the limit."""
    changed = state.agg(F.coalesce(F.sum("changed"), F.lit(0))).head()[0]
    return nodes <= small or changed > limit * max(1, files)


def with_pending(base: DataFrame, pending: DataFrame, key: str = "id") -> DataFrame:
    """Vectors that are written, with those that aren't yet in their place."""
    return base.join(pending.select(key), key, "left_anti").unionByName(pending.select(base.columns))


def symbol_table(symbols: DataFrame) -> DataFrame:
    """(name, norm, id, file, qname, label, place): the candidates of every name in the order that ties are broken by."""
    place = F.row_number().over(Window.partitionBy("name").orderBy("file", "qname", "label", "id"))
    return symbols.where("label IN ('Function', 'Class')").select("name", name_norm(F.col("name")).alias("norm"), "id", "file", "qname", "label", place.alias("place"))


def reference_index(raw: DataFrame) -> DataFrame:
    """(name, norm, path): which files refer to a name."""
    refs = raw.where("rel IN ('CALLS', 'INHERITS', 'INSTANTIATES', 'DECORATED_BY', 'IMPORTS_SYMBOL')")
    return refs.select("name", name_norm(F.col("name")).alias("norm"), "path").distinct()


def to_resolve(changed: DataFrame, old: DataFrame, new: DataFrame, raw: DataFrame, old_imports: DataFrame, new_imports: DataFrame, hops: int = 3) -> DataFrame:
    """(path): the files whose references a change can decide otherwise.

    Those that changed; those that refer to a name (or its normal form) that the
    changed files define now or did before; those whose imports lead elsewhere;
    and what is within `hops` imports of these, before or after, as distance
    decides between candidates.  old and new: symbols (name, file); imports:
    (path, rel, module, name, alias, line, file).
    """
    from weftgraph.operators.traverse import frontier

    own = changed.select("path")
    names = old.select("name", "file").unionByName(new.select("name", "file")).join(own.select(F.col("path").alias("file")), "file", "left_semi").select(name_norm(F.col("name")).alias("norm")).distinct()
    by_name = reference_index(raw).join(names, "norm", "left_semi").select("path")
    led = new_imports.select(old_imports.columns)
    moved = old_imports.exceptAll(led).unionByName(led.exceptAll(old_imports)).select("path", "file")
    ends = cut(moved.select("path").unionByName(moved.where("file IS NOT NULL").select(F.col("file").alias("path"))).distinct(), "moved-imports")
    links = old_imports.unionByName(led).where("file IS NOT NULL").select(F.col("path").alias("src"), F.col("file").alias("dst")).distinct()
    near = frontier(ends.select(F.lit(0).alias("seed"), F.col("path").alias("id")), cut(links, "import-links"), hops, direction="both").select(F.col("id").alias("path"))
    return own.unionByName(by_name).unionByName(near).distinct()


class Quiet:
    """Whether maintenance is due: something has changed, and nothing more for `seconds`."""

    def __init__(self, seconds: float = 3.0):
        self.seconds, self.generation, self.done, self.at = seconds, 0, 0, 0.0

    def changed(self, now: float) -> None:
        self.generation, self.at = self.generation + 1, now

    def due(self, now: float) -> bool:
        return self.generation > self.done and now - self.at >= self.seconds

    def run(self, work, now: float) -> bool:
        """Run work() if it is due; a change that comes meanwhile leaves it due again."""
        if not self.due(now):
            return False
        generation = self.generation
        work()
        self.done = generation
        return True


class Cancelled(Exception):
    """A pass ended at a phase's boundary because it was asked to."""


class Pass:
    """Phases of a pass under one tag: cancel() interrupts its Spark jobs, and the next phase doesn't begin."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.stopped, self.events = spark, tag, False, []

    def phase(self, name: str, work):
        if self.stopped:
            raise Cancelled(name)
        self.events.append(("start", name))
        self.spark.addTag(self.tag)
        try:
            out = work()
        finally:
            self.spark.removeTag(self.tag)
        self.events.append(("end", name))
        return out

    def cancel(self) -> None:
        self.stopped = True
        self.spark.interruptTag(self.tag)


class Progress(StreamingQueryListener):
    """Events of streaming queries, as a list of (event, name, rows)."""

    def __init__(self):
        self.events: list[tuple[str, str | None, int]] = []

    def onQueryStarted(self, event):
        self.events.append(("started", event.name, 0))

    def onQueryProgress(self, event):
        self.events.append(("progress", event.progress.name, event.progress.numInputRows))

    def onQueryIdle(self, event):
        self.events.append(("idle", None, 0))

    def onQueryTerminated(self, event):
        self.events.append(("terminated", None, 0))
