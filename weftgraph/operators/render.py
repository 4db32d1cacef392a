"""Reports as text, on the driver, from small ordered results: repository maps, context, wiki pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions.text import estimate_tokens
from weftgraph.operators import lookup
from weftgraph.operators.traverse import frontier


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def repo_map(symbols: DataFrame, ranks: DataFrame, budget: int = 2000, pool: int = 1500) -> str:
    """Signatures of the highest ranked symbols by file, methods under their class, within a budget of tokens."""
    budget = max(64, min(32_000, budget))
    rows = symbols.where("NOT is_test").where(~F.contains("file", F.lit("/test"))).drop("pagerank").join(ranks, "id")
    top = rows.select("id", "file", "qname", "line_start", F.coalesce("signature", "name").alias("signature"), "pagerank").orderBy(F.desc("pagerank"), "qname").limit(pool)
    fit = lookup.within_budget(top.withColumn("_t", estimate_tokens(F.col("signature")) + 2), "_t", [F.desc("pagerank"), "qname"], budget)
    by_file: dict[str, list] = {}
    # at most `pool` rows reach the driver
    for r in fit.collect():
        by_file.setdefault(r.file, []).append(r)
    shown = sorted(by_file.items(), key=lambda kv: -max(r.pagerank for r in kv[1]))
    while True:
        out = []
        for file, rows_ in shown:
            out.append(f"{file}:")
            last = 0
            for r in sorted(rows_, key=lambda r: r.line_start):
                if last and r.line_start > last + 1:
                    out.append("|...")
                depth = r.qname.count("::") - 1
                out.append("|" + "    " * max(0, depth) + r.signature)
                last = r.line_start
        text = "\n".join(out)
        if tokens(text) <= budget or not shown:
            return text
        file, rows_ = shown.pop()
        if len(rows_) > 1:
            shown.append((file, sorted(rows_, key=lambda r: -r.pagerank)[:-1]))


def trim_sections(sections: list[tuple[str, list[str]]], budget: int) -> list[tuple[str, list[str]]]:
    """Sections with lines dropped a third at a time, the last section first, until they fit; the first keeps a line."""
    sections = [(t, list(x)) for t, x in sections]

    def size() -> int:
        return tokens("\n".join("\n".join([t, *x]) for t, x in sections if x))

    for k in range(len(sections) - 1, -1, -1):
        title, rows = sections[k]
        while rows and size() > budget:
            keep = len(rows) - max(1, len(rows) // 3)
            rows = rows[: max(keep, 1 if k == 0 else 0)]
            sections[k] = (title, rows)
            if k == 0 and len(rows) == 1:
                break
    return [(t, x) for t, x in sections if x]


def context(symbols: DataFrame, edges: DataFrame, ranks: DataFrame, name: str, budget: int = 4000) -> str:
    """Definition, callers, callees, tests and kin of a symbol, trimmed to a budget of tokens."""
    budget = max(200, min(32_000, budget))
    own = lookup.pick(symbols.drop("pagerank"), ranks, name).collect()
    if not own:
        return ""
    s = own[0]
    spark = symbols.sparkSession
    seed = spark.createDataFrame([(0, s.id)], "seed int, id long")
    calls = edges.where("rel = 'CALLS'")
    info = symbols.select("id", "qname")
    near = frontier(seed, calls, 2, direction="in").where("depth > 0").join(ranks, "id", "left").join(calls.where(F.col("dst") == s.id).groupBy(F.col("src").alias("id")).agg(F.max("confidence").alias("c")), "id", "left")
    callers = near.withColumn("score", F.coalesce("pagerank", F.lit(0.0)) * F.coalesce("c", F.lit(0.5)) / F.col("depth")).join(info, "id").orderBy(F.desc("score"), "qname").limit(50).collect()
    callees = calls.where(F.col("src") == s.id).groupBy(F.col("dst").alias("id")).agg(F.min("line").alias("line")).join(info, "id").orderBy("line", "qname").limit(50).collect()
    tests = edges.where((F.col("rel") == "TESTS") & (F.col("dst") == s.id)).select(F.col("src").alias("id")).join(info, "id").orderBy("qname").limit(50).collect()
    kin = edges.where(F.col("rel") == "SIMILAR_TO").where((F.col("src") == s.id) | (F.col("dst") == s.id)).select(F.when(F.col("src") == s.id, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct().join(info, "id").orderBy("qname").limit(8).collect()
    sections = [
        ("Definition", [f"{s.qname} ({s.label}) lines {s.line_start}-{s.line_end}", s.signature or ""]),
        ("Callers", [f"{r.qname} (depth {r.depth})" for r in callers]),
        ("Callees", [f"{r.qname} (line {r.line})" for r in callees]),
        ("Tests", [r.qname for r in tests]),
        ("Source", (s.body or "").split("\n")[:80]),
        ("Similar", [r.qname for r in kin]),
    ]
    return "\n".join("\n".join([f"## {t}", *x]) for t, x in trim_sections(sections, budget))


def wiki_pages(symbols: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """(module, page): Markdown with a module's leading classes and functions and the modules that it calls and that call it."""
    from pyspark.sql import Window

    from weftgraph.functions.text import module_bucket

    rows = symbols.withColumn("module", module_bucket(F.col("file"), depth))
    place = F.row_number().over(Window.partitionBy("module", "label").orderBy(F.desc(F.coalesce("pagerank", F.lit(0.0))), "qname"))
    top = rows.withColumn("_r", place).where("_r <= 10").groupBy("module").agg(F.array_sort(F.collect_list(F.struct("label", "_r", "qname"))).alias("top"), F.count_distinct("file").alias("files"))
    where = rows.select("id", "module")
    links = edges.where("rel = 'CALLS'").join(where.select(F.col("id").alias("src"), F.col("module").alias("a")), "src").join(where.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    uses = links.groupBy(F.col("a").alias("module")).agg(F.array_sort(F.collect_list("b")).alias("uses"))
    used = links.groupBy(F.col("b").alias("module")).agg(F.array_sort(F.collect_list("a")).alias("used"))
    lines = F.transform("top", lambda x: F.concat(F.lit("- "), x["label"], F.lit(" `"), x["qname"], F.lit("`")))
    page = F.concat_ws("\n", F.concat(F.lit("# "), F.col("module")), F.array_join(lines, "\n"), F.concat(F.lit("Uses: "), F.coalesce(F.array_join("uses", ", "), F.lit("none"))), F.concat(F.lit("Used by: "), F.coalesce(F.array_join("used", ", "), F.lit("none"))))
    return top.join(uses, "module", "left").join(used, "module", "left").select("module", page.alias("page"))
