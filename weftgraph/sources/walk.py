"""Which files there are, which count, and what changed: metadata scans, ignore rules, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftgraph.functions.text import matches_any
from weftgraph.sources.classify import MAX_FILE_BYTES, kind

#: Patterns of files that mark an ecosystem, with what its tools leave behind.
ECOSYSTEMS = {
    "python": (["pyproject.toml", "setup.py", "setup.cfg", "requirements*.txt", "Pipfile"], ["__pycache__/", "*.egg-info/", ".venv/", "venv/", ".tox/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/"]),
    "node": (["package.json"], ["node_modules/", "dist/", ".next/", ".nuxt/", "coverage/", "*.min.js"]),
    "rust": (["Cargo.toml"], ["target/"]),
    "go": (["go.mod"], ["vendor/"]),
    "java": (["pom.xml", "build.gradle", "build.gradle.kts"], ["target/", "build/", ".gradle/", "*.class"]),
    "dotnet": (["*.csproj", "*.fsproj", "*.sln"], ["bin/", "obj/"]),
    "ruby": (["Gemfile"], [".bundle/", "vendor/bundle/"]),
    "php": (["composer.json"], ["vendor/"]),
    "elixir": (["mix.exs"], ["_build/", "deps/"]),
    "swift": (["Package.swift"], [".build/"]),
    "dart": (["pubspec.yaml"], [".dart_tool/"]),
    "haskell": (["*.cabal", "stack.yaml"], [".stack-work/", "dist-newstyle/"]),
    "terraform": (["*.tf"], [".terraform/"]),
}
#: What no index wants, whatever the ecosystem.
UNIVERSAL = [".git/", ".hg/", ".svn/", ".idea/", ".vscode/", ".DS_Store", "*.lock", "*.log", "*.tmp"]
STATS = "path string, size long, modified timestamp"


def ecosystems(paths: DataFrame, markers: dict | None = None) -> DataFrame:
    """(ecosystem, files): ecosystems whose marker files are among the paths (path), in any folder."""
    name = F.element_at(F.split("path", "/"), -1)
    marked = [F.when(matches_any(name, globs), F.lit(e)) for e, (globs, _) in (markers or ECOSYSTEMS).items()]
    found = paths.select(F.explode(F.array_compact(F.array(*marked))).alias("ecosystem"))
    return found.groupBy("ecosystem").agg(F.count(F.lit(1)).alias("files"))


def parse_ignore(text: str) -> list[str]:
    """Patterns of an ignore file: one a line, without comments and blank lines; ! takes back what an earlier one ignores."""
    lines = (line.strip() for line in text.splitlines())
    return [x for x in lines if x and x[0] != "#"]


def ignore_list(found: list[str], *user_files: str) -> list[str]:
    """Universal patterns, those of the ecosystems, then those of ignore files (their texts); each once, in that order."""
    out = [*UNIVERSAL, *(p for e in sorted(found) for p in ECOSYSTEMS[e][1]), *(p for t in user_files for p in parse_ignore(t))]
    return list(dict.fromkeys(out))


def stats(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """Rows of STATS, with kind: files under root that count, by metadata alone; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace("path", "^file:/*" + base.lstrip("/") + "/", "")
    rows = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return relevant(rows, ignore)


def relevant(rows: DataFrame, ignore: list[str] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Rows (path, size, ...) of files that are read, with their kind; one without a size (deleted) is judged by its name."""
    fits = F.col("size").isNull() | (F.col("size") <= max_bytes)
    return rows.withColumn("kind", kind(F.col("path"))).where(F.col("kind").isNotNull() & fits & ~matches_any(F.col("path"), list(ignore)))


def stat_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state): added, changed or deleted by size and time of two metadata scans; files alike in both are left out."""
    both = now.select("path", F.col("size").alias("s"), F.col("modified").alias("m")).join(before.select("path", F.col("size").alias("s0"), F.col("modified").alias("m0")), "path", "full_outer")
    state = F.when(F.col("s0").isNull(), "added").when(F.col("s").isNull(), "deleted").when((F.col("s") != F.col("s0")) | ~F.col("m").eqNullSafe(F.col("m0")), "changed")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")


def classify_events(events: DataFrame, now: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state): what stands behind events (path): present files, and gone ones, which known (path) had; a gone folder takes all under it."""
    seen = events.select(F.rtrim(F.regexp_replace("path", "/+$", "")).alias("path")).distinct()
    present = seen.join(now.select("path"), "path", "left_semi").select("path", F.lit("present").alias("state"))
    missing = known.select("path").join(now.select("path"), "path", "left_anti")
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    gone = missing.select("path", F.explode(folders).alias("at")).join(seen.withColumnRenamed("path", "at"), "at", "left_semi")
    return present.unionByName(gone.select("path", F.lit("gone").alias("state")).distinct())


def redacted(column: Column, path: Column, blocked: list[str], mark: str = "[redacted by .cursorignore]") -> Column:
    """column, or a mark in its place where the path is blocked; null stays null."""
    if not blocked:
        return column
    return F.when(column.isNotNull() & matches_any(path, blocked), F.lit(mark)).otherwise(column)


def file_content(files: DataFrame, path: str, blocked: list[str] = ()) -> DataFrame:
    """(path, text) of one known file, redacted if it is blocked; a path that isn't in the table (or leads out of the root) gives no row."""
    return files.where(F.col("path") == path).select("path", redacted(F.col("text"), F.col("path"), list(blocked)).alias("text"))
