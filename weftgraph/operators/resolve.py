"""Raw references to edges, by a cascade of equi-joins with a confidence each.

Every tier is a join on name (and file), so a name that very many symbols share
costs counts and a few first candidates, never all pairs.  The first tier that
decides a reference wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.functions.text import name_norm
from weftgraph.operators.traverse import frontier
from weftgraph.storage import cut

#: Confidence of each way to resolve a reference.
CONFIDENCE = {"scip": 1.0, "import_map": 0.95, "same_module": 0.90, "import_suffix": 0.85, "unique_global": 0.75, "import_distance": 0.55, "same_module_multi": 0.55, "common_name": 0.40, "fuzzy": 0.40, "fuzzy_ranked": 0.30}
#: Receivers that mean the own object, and method names too common to tell by themselves.
SELF = ["self", "this", "cls", "super", "Self"]
COMMON = """get set put pop add append extend insert remove update items keys values copy clear sort index count join split strip
lstrip rstrip replace format encode decode lower upper startswith endswith find read write close open send recv run start stop wait list
load loads dump dumps match search sub exists mkdir resolve render then catch push map filter reduce forEach toString log info debug error
warning execute fetch call apply next emit on""".split()
ALTERNATIVES, AMBIGUOUS = 4, 5


def modules(files: DataFrame) -> DataFrame:
    """(module, file): every dotted or slashed suffix by which a file may be imported."""
    bare = F.regexp_replace(F.regexp_replace("path", r"\.(?:pyi?|jsx?|tsx?|mjs|cjs|java|go|kt|scala|rs|rb|php|swift|dart|lua|hs|jl|ml)$", ""), r"/(?:__init__|index|mod)$", "")
    parts = F.split(bare, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return files.select(F.col("path").alias("file"), F.explode(tails).alias("module"), F.size(parts).alias("parts"))


def imports(raw: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, name, alias, line, file): imports, with up to two files each (null: outside)."""
    own = raw.where("rel IN ('IMPORTS', 'IMPORTS_SYMBOL')").select("path", "rel", F.col("module").alias("text"), "name", "alias", "line")
    folder = F.regexp_replace("path", "[^/]*$", "")
    rel = F.regexp_replace(F.concat(folder, F.col("text")), r"(?:^|(?<=/))\./", "")
    for _ in range(4):
        rel = F.regexp_replace(rel, r"(?:^|(?<=/))[^/.][^/]*/\.\./", "")
    dotted = F.when(F.startswith("text", F.lit(".")), F.replace(F.regexp_replace(rel, r"\.(?:jsx?|tsx?|mjs|cjs)$", ""), F.lit("/"), F.lit("."))).otherwise(F.replace(F.col("text"), F.lit("/"), F.lit(".")))
    own = own.withColumn("module", dotted)
    hit = own.join(modules(files), "module", "left").where("file IS NULL OR file <> path")
    order = Window.partitionBy("path", "rel", "text", "name", "line").orderBy("parts", "file")
    return hit.withColumn("_r", F.row_number().over(order)).where("_r <= CASE WHEN startswith(text, '.') THEN 1 ELSE 2 END").select("path", "rel", F.col("text").alias("module"), "name", "alias", "line", "file")


def resolve(raw: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(rel, src, dst, line, confidence, method): resolved references, and candidates of those that are not sure.

    symbols: (id, name, qname, file, label); raw as sources.code gives them.
    Calls go from functions to functions; inheritance and construction to
    classes; decoration to functions.
    """
    imp = cut(imports(raw, files), "imports")
    last = symbols.groupBy("qname").agg(F.max("id").alias("sid"), F.max_by("label", "id").alias("slabel"))
    refs = raw.where("rel IN ('CALLS', 'INHERITS', 'INSTANTIATES', 'DECORATED_BY')").join(last.withColumnRenamed("qname", "src"), "src")
    refs = refs.where("(rel NOT IN ('CALLS', 'INSTANTIATES') OR slabel = 'Function') AND (rel <> 'INHERITS' OR slabel = 'Class')")
    head = F.element_at(F.split("recv", r"\."), 1)
    kind = F.when(F.col("recv").isNull() & ~F.col("attr"), "bare").when(F.col("recv").isNull(), "object").when(head.isin(SELF), "self").otherwise("object")
    want = F.when(F.col("rel").isin("INHERITS", "INSTANTIATES"), "Class").otherwise("Function")
    refs = cut(refs.select(F.xxhash64("path", "rel", "src", "name", "line", F.coalesce("recv", F.lit(""))).alias("rid"), "path", "rel", F.col("sid").alias("src"), "name", "line", head.alias("head"), F.when(F.col("rel") == "CALLS", kind).otherwise("bare").alias("kind"), want.alias("want"), "attr").dropDuplicates(["rid"]), "references")
    cand = symbols.where("label IN ('Function', 'Class')").select("id", "name", "file", "qname", F.col("label").alias("want"), (F.size(F.split("qname", "::")) >= 3).alias("method"))
    cand = cut(cand, "candidates")
    key = ["name", "want"]

    per_name = cand.groupBy(*key).agg(F.count(F.lit(1)).alias("n_all"), F.count_if("method").alias("n_method"), F.min("id").alias("first_all"), F.min(F.when(F.col("method"), F.col("id"))).alias("first_method"), F.min(F.when(~F.col("method"), F.col("id"))).alias("first_plain"))
    base = refs.join(per_name, key, "left").fillna(0, ["n_all", "n_method"])
    # receivers that are imported modules, and names that are imported symbols
    as_name = F.coalesce("alias", F.element_at(F.split("module", r"[./]"), -1), "name")
    alias = imp.where("rel = 'IMPORTS'").select("path", as_name.alias("head"), "file").distinct()
    through = refs.where("kind = 'object'").join(alias, ["path", "head"])
    inside = through.join(cand.select("id", *key, "file"), [*key, "file"], "left").groupBy("rid").agg(F.countDistinct("id").alias("n"), F.min("id").alias("dst"))
    by_alias = inside.select("rid", F.when(F.col("n") == 1, F.col("dst")).alias("dst"), F.when(F.col("n") == 1, "import_map").otherwise("external").alias("method"))
    named = imp.where("rel = 'IMPORTS_SYMBOL' AND file IS NOT NULL").select("path", F.coalesce("alias", "name").alias("name"), F.col("name").alias("real"), "file")
    mapped = refs.where("kind = 'bare'").join(named, ["path", "name"]).join(cand.select("id", F.col("name").alias("real"), "want", "file"), ["real", "want", "file"]).groupBy("rid").agg(F.countDistinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1").select("rid", "dst", F.lit("import_map").alias("method"))

    here = refs.join(cand.select("id", *key, F.col("file").alias("path"), F.col("method").alias("m")), [*key, "path"])
    here = here.where("(kind <> 'object' OR m)").groupBy("rid", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((~F.col("m") & (F.col("kind") == "self")).alias("_o"), "id")).getField("id").alias("dst"), F.count_if("m").alias("nm"))
    n_here = F.when((F.col("kind") == "self") & (F.col("nm") > 0), F.col("nm")).otherwise(F.col("n"))
    same = here.select("rid", "dst", F.when(n_here == 1, "same_module").otherwise("same_module_multi").alias("method"))

    fits = "(kind = 'object' AND m) OR (kind = 'bare' AND NOT m) OR (kind = 'self' AND (m OR n_method = 0))"
    links = imp.where("file IS NOT NULL").select(F.col("path").alias("src"), F.col("file").alias("dst")).distinct()
    pool = cand.select("id", *key, "file", F.col("method").alias("m"))
    near = base.join(links.withColumnRenamed("src", "path").withColumnRenamed("dst", "file"), "path").join(pool, [*key, "file"]).where(fits).groupBy("rid").agg(F.countDistinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1").select("rid", "dst", F.lit("import_suffix").alias("method"))

    n_fit = F.when(F.col("kind") == "object", F.col("n_method")).when(F.col("kind") == "bare", F.col("n_all") - F.col("n_method")).otherwise(F.when(F.col("n_method") > 0, F.col("n_method")).otherwise(F.col("n_all")))
    first = F.when(F.col("kind") == "object", F.col("first_method")).when(F.col("kind") == "bare", F.col("first_plain")).otherwise(F.coalesce("first_method", "first_all"))
    counted = base.withColumn("n_fit", n_fit)
    single = counted.where("n_fit = 1").select("rid", first.alias("dst"), F.when(F.col("attr") & F.col("name").isin(COMMON), "common_name").otherwise("unique_global").alias("method"))
    outside = counted.where("kind = 'object' AND n_method = 0").select("rid", F.lit(None).cast("long").alias("dst"), F.lit("external").alias("method"))

    order = ["external_alias", "import_map", "same", "suffix", "single", "outside"]
    tiers = by_alias.withColumn("t", F.lit(0))
    for k, part in enumerate((mapped, same, near, single, outside), 1):
        tiers = tiers.unionByName(part.withColumn("t", F.lit(k)))
    assert len(order) == 6
    # an object that is no module and whose name no method has comes before the file tiers
    rank = F.when((F.col("method") == "external") & (F.col("t") == 5), 0.5).otherwise(F.col("t"))
    decided = cut(tiers.groupBy("rid").agg(F.min(F.struct(rank.alias("o"), "dst", "method")).alias("b")).select("rid", "b.dst", "b.method"), "decided")

    open_ = cut(counted.join(decided.select("rid"), "rid", "left_anti"), "open")
    hops = frontier(open_.select(F.col("path").alias("seed"), F.col("path").alias("id")).distinct(), links.withColumn("confidence", F.lit(1.0)), 3, direction="both").where("depth > 0").select(F.col("seed").alias("path"), F.col("id").alias("file"), "depth")
    from weftgraph.functions.text import shared_prefix, stem

    reach = open_.where("n_fit > 1").join(hops, "path").join(pool, [*key, "file"]).where(fits)
    score = F.lit(3.0) / F.col("depth") + F.when(F.col("head") == stem(F.col("file")), 2.0).otherwise(0.0) + 0.25 * shared_prefix(F.col("path"), F.col("file"))
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "id")
    scored = reach.withColumn("score", score).withColumn("r", F.row_number().over(best)).withColumn("second", F.lead("score").over(best))
    far = cut(scored.where("r = 1 AND score > 0 AND (second IS NULL OR score > second)").select("rid", F.col("id").alias("dst"), F.lit("import_distance").alias("method")), "by-distance")

    few = Window.partitionBy("name", "want", "method").orderBy("file", "qname", "id")
    listed = cand.withColumn("r", F.row_number().over(few)).where(F.col("r") <= AMBIGUOUS).select("id", *key, F.col("method").alias("m"), "file")
    ambiguous = open_.where("n_fit > 1").join(listed.drop("file"), key).where(fits)
    cut_at = Window.partitionBy("rid").orderBy("id")
    alternatives = ambiguous.join(far.select("rid", F.col("dst").alias("won")), "rid", "left").where("won IS NULL OR id <> won").withColumn("r", F.row_number().over(cut_at)).where(F.col("r") <= F.when(F.col("won").isNull(), AMBIGUOUS).otherwise(ALTERNATIVES))
    n_alt = F.least(F.col("n_fit"), F.lit(AMBIGUOUS))
    share = F.when(F.col("won").isNull(), F.round(0.5 / n_alt, 3)).otherwise(F.round(0.5 / (F.least(F.col("n_fit") - 1, F.lit(ALTERNATIVES)) + 1), 3))
    maybe = alternatives.where("rel = 'CALLS'").select(F.lit("CALLS_CANDIDATE").alias("rel"), "src", F.col("id").alias("dst"), "line", share.alias("confidence"), F.when(F.col("won").isNull(), "ambiguous").otherwise("alternative").alias("method"))

    plain = open_.where("n_all = 0 AND kind <> 'object' AND length(name) >= 5 AND NOT startswith(name, '__') AND NOT name RLIKE '^[A-Z]'").withColumn("norm", name_norm(F.col("name")))
    alike = plain.join(cand.select("id", name_norm(F.col("name")).alias("norm"), F.col("name").alias("other"), "want", "file"), ["norm", "want"]).where("replace(name, '_', '') = replace(other, '_', '')")
    fuzzy = alike.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((F.col("file") != F.col("path")).alias("o"), "file", "id")).getField("id").alias("dst")).select("rid", "dst", F.when(F.col("n") == 1, "fuzzy").otherwise("fuzzy_ranked").alias("method"))

    sure = decided.where("dst IS NOT NULL").unionByName(far).unionByName(fuzzy)
    value = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    edges = refs.join(sure, "rid").where("src <> dst OR rel = 'CALLS'").select("rel", "src", "dst", "line", F.element_at(value, F.col("method")).alias("confidence"), "method")
    return edges.unionByName(maybe)
