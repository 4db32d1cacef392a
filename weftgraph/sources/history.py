"""Version history: diffs, logs and blame, from text that git prints (the driver runs git)."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout


def diff_text(repo: str, ref: str | None = None) -> str:
    """A unified diff without context: the working tree, a commit, a branch, or a range a..b."""
    if ref is None or ref == "HEAD":
        return git(repo, "diff", "-U0", "HEAD")
    return git(repo, "diff", "-U0", ref) if ".." in ref else git(repo, "diff", "-U0", f"{ref}^", ref)


def parse_diff(text: str) -> list[dict]:
    """Files of a unified diff: path, status, ranges of new lines, counts of added and removed lines.

    A hunk's header says how many old and new lines follow; only what is beyond
    them is a header again, so changed lines may look like anything.  A deletion
    is anchored at the line before it (at 1 at the least).
    """
    files: list[dict] = []
    cur: dict | None = None
    old = new = 0
    named = False

    def start(path: str) -> dict:
        files.append({"path": path, "status": "modified", "ranges": [], "added": 0, "removed": 0})
        return files[-1]

    for line in text.split("\n"):
        if cur is not None and (old > 0 or new > 0):
            if line.startswith("+"):
                cur["added"] += 1
                new -= 1
            elif line.startswith("-"):
                cur["removed"] += 1
                old -= 1
            elif not line.startswith("\\"):  # a line of context; the other is git's note on a missing last line end
                old, new = old - 1, new - 1
            continue
        if line.startswith("diff --git "):
            cur, named = start(line.rsplit(" b/", 1)[-1]), True
        elif line.startswith("--- "):
            # without git's own header every pair of names begins a file
            if not named:
                cur = start(_diff_name(line[4:]))
        elif line.startswith("+++ ") and cur is not None:
            named = False
            if line[4:].split("\t")[0] == "/dev/null":
                cur["status"] = "deleted"
            elif cur["status"] != "renamed":
                cur["path"] = _diff_name(line[4:])
        elif cur is not None and line.startswith("new file"):
            cur["status"] = "added"
        elif cur is not None and line.startswith("deleted file"):
            cur["status"] = "deleted"
        elif cur is not None and line.startswith("rename to "):
            cur["status"], cur["path"] = "renamed", line[10:]
        elif cur is not None and (m := _HUNK.match(line)):
            old, new = (int(m[k]) if m[k] is not None else 1 for k in (2, 4))
            a = max(int(m[3]), 1)
            cur["ranges"].append((a, a + max(new - 1, 0)))
    return files


def _diff_name(name: str) -> str:
    name = name.split("\t")[0]
    return name[2:] if name[:2] in ("a/", "b/") else name


def diff_ranges(spark: SparkSession, text: str) -> DataFrame:
    """(file, status, s, e, added, removed): a row per changed range; a deleted file has one range over all lines."""
    rows = []
    for f in parse_diff(text):
        for a, b in f["ranges"] if f["status"] != "deleted" else [(1, 1 << 30)]:
            rows.append((f["path"], f["status"], a, b, f["added"], f["removed"]))
    return spark.createDataFrame(rows, "file string, status string, s int, e int, added int, removed int")


def commits(spark: SparkSession, repo: str, last: int = 200) -> DataFrame:
    """(commit, ts, author, subject, file) of the last commits."""
    rows, head = [], None
    for line in git(repo, "log", f"-{last}", "--name-only", "--format=%x01%H%x02%at%x02%an%x02%s").split("\n"):
        if line.startswith("\x01"):
            head = line[1:].split("\x02")
        elif line.strip() and head:
            rows.append((head[0], int(head[1]), head[2], head[3], line.strip()))
    return spark.createDataFrame(rows, "commit string, ts long, author string, subject string, file string")


BLAME = "file string, line int, commit string, ts long, author string"


def parse_blame(path: str, text: str) -> list[tuple]:
    """Rows of BLAME from git's line porcelain; a null time is a line that is not committed."""
    rows, sha, ts, n, author = [], "", None, 0, ""
    for line in text.split("\n"):
        if m := re.match(r"^([0-9a-f]{40}) \d+ (\d+)", line):
            sha, n = m[1], int(m[2])
        elif line.startswith("author "):
            author = line[7:]
        elif line.startswith("author-time "):
            ts = int(line[12:])
        elif line.startswith("\t"):
            rows.append((path, n, sha, None if set(sha) == {"0"} else ts, author))
    return rows


def blame(spark: SparkSession, repo: str, paths: list[str] | DataFrame) -> DataFrame:
    """Rows of BLAME: tasks run git, each over its share of the paths; repo is a folder that they all see."""
    import pandas as pd

    files = paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")

    def run(batches):
        names = [c.split()[0] for c in BLAME.split(", ")]
        for pdf in batches:
            rows = [r for p in pdf["path"] for r in parse_blame(p, git(repo, "blame", "--line-porcelain", "--", p))]
            yield pd.DataFrame(rows, columns=names).astype({"line": "Int32", "ts": "Int64"})

    return files.select("path").mapInPandas(run, BLAME)


def blame_range(lines: DataFrame, file: str, first: int, last: int) -> DataFrame:
    """(line, commit, author, date) of a range of a file's blamed lines; an uncommitted line has no date."""
    from pyspark.sql import functions as F

    own = lines.where((F.col("file") == file) & F.col("line").between(first, last))
    return own.select("line", F.substring("commit", 1, 12).alias("commit"), "author", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("date"))


def symbol_log(spark: SparkSession, repo: str, file: str, first: int, last: int, limit: int = 20) -> DataFrame:
    """(commit, ts, author, subject): the commits that changed a range of lines, newest first; none where git can't follow it."""
    try:
        out = git(repo, "log", f"-{limit}", "-s", f"-L{first},{last}:{file}", "--format=%x01%H%x02%at%x02%an%x02%s")
    except subprocess.CalledProcessError:
        out = ""
    rows = [(h, int(t), a, s) for h, t, a, s in (line[1:].split("\x02", 3) for line in out.split("\n") if line.startswith("\x01"))]
    return spark.createDataFrame(rows, "commit string, ts long, author string, subject string")


def recent(commits: DataFrame, limit: int = 20, file: str | None = None) -> DataFrame:
    """(commit, ts, author, subject): the last commits, of one file if it is given; newest first, ties by commit."""
    from pyspark.sql import functions as F

    own = commits.where(F.col("file") == file) if file is not None else commits
    heads = own.select("commit", "ts", "author", "subject").distinct()
    return heads.orderBy(F.desc("ts"), F.desc("commit")).limit(limit)
