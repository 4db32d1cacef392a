"""Personal data by weak supervision, in DataFrame operations alone.

Candidates of each kind come from patterns: strict ones, whose matches are
always kept, and loose ones (numbers that fail their check digit, telephone
numbers without a country code, spelt-out addresses, quoted credentials).
Labelers of three sorts vote on every candidate: for it, against it or not at
all.

* regex: the strict pattern with its checks; the usual layout of the kind
* gazetteer: known top-level domains, reserved address blocks, card issuers,
  country codes
* context: words before the candidate that announce the kind, or another use

Expectation-maximisation over the histogram of votes estimates how reliable
each labeler is and how likely each pattern of votes is personal data.  With
these as soft labels a logistic classifier over votes, kind and length is
fitted; it decides on the loose candidates.  The histogram has at most
kinds * 3**labelers * LENGTHS rows whatever the input, and is all that reaches
the driver; the classifier goes back as a literal list of accepted patterns.

Spans are counted in code points, the end exclusive.  Patterns are possessive
and start at the beginning of a run of their characters (or where the last
match ended), which finds the same matches in linear time and without deep
recursion however long a text is.

Defined cases: null text is empty; repeated rows are judged each; a table
without candidates accepts none; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.shared import cut, free_names, only

KINDS = ["email", "ip", "card", "phone", "secret"]
LENGTHS = 6

#: The strict patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: The loose patterns.
SPELT = r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++ ?[(\[]at[)\]] ?[a-z0-9-]++(?: ?[(\[]dot[)\]] ?[a-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"(?i)(?:token|secret|password|passwd|api[_-]?key)\s{0,4}[=:]\s{0,4}(?:\"[^\"\s]{8,}+\"|'[^'\s]{8,}+'|(?=[a-z+/_.~=-]*+[0-9])[a-z0-9+/_.~=-]{8,}+)"
KEY = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|-----BEGIN (?:[A-Z]++ )*PRIVATE KEY-----)"
#: Gazetteers.
DOMAINS = ["at", "au", "be", "br", "ca", "ch", "cn", "co", "com", "de", "dk", "edu", "es", "eu", "fi", "fr", "gov", "ie", "in", "info", "io", "it", "jp", "mil", "mx", "net", "nl", "no", "org", "pl", "pt", "ru", "se", "uk", "us"]
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]?"
#: Words that announce a kind, and words that announce other numbers.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|address|from|reply)\W",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client)\W",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|pan)\W",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telephone|whatsapp)\W",
    "secret": r"(?i)\b(?:token|secret|password|key)\b",
}
OTHER_USE = r"(?i)\b(?:version|release|isbn|order|invoice|section|chapter|example|serial|item)\W{0,3}(?:no\.?|number)?\W{0,3}$"

#: Matches of a text that are placed in one go.
BLOCK = 256
_FOUND = "array<struct<s:int,e:int,m:string>>"


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<s, e, m>>: all leftmost non-overlapping matches, by the lengths of what stands between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    zero, none = F.lit(0), F.array().cast(_FOUND)

    def place(some: Column, at: Column) -> Column:
        def step(acc, x):
            s = acc["at"] + x["g"]
            e = s + F.length(x["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

        return F.aggregate(some, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])

    # in blocks, each from the place where the block before it ends: appending is quadratic in a block alone
    block = lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK))
    blocks = F.sequence(zero, F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
    long = F.transform(blocks, lambda b: F.aggregate(block(b), zero, lambda n, x: n + x["g"] + F.length(x["m"])))
    starts = F.aggregate(long, F.array(zero), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    many = F.flatten(F.zip_with(blocks, F.slice(starts, zero + 1, F.size(blocks)), lambda b, at: place(block(b), at)))
    return F.when(gate, F.when(F.size(pairs) <= BLOCK, place(pairs, zero)).otherwise(many)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.split(F.reverse(_digits(m)), "")
    value = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.coalesce(F.aggregate(F.filter(value, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0, F.lit(False))


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.regexp_replace(p, "^0+(?=.)", "")).otherwise("999").cast("int"), F.lit(0)) <= 255))


def _n_digits(m: Column) -> Column:
    return F.length(_digits(m))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), F.lit("+")).when(F.coalesce(no, F.lit(False)), F.lit("-")).otherwise(F.lit("0"))


def _labelled(found: Column, kind: str, text: Column, strict=None) -> Column:
    """Candidates with the labelers' votes as a string, and whether they are strict (no check: loose, and no vote on it)."""
    layout = {
        "email": lambda m: (m.rlike(r"\.[A-Za-z]{2,24}$"), m.rlike(r"\.\.|^\.|-$")),
        "ip": lambda m: (m.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), m.rlike(r"(?:^|\.)0[0-9]")),
        "card": lambda m: (_n_digits(m).isin(15, 16), _n_digits(m) > 19),
        "phone": lambda m: (m.rlike(r"[0-9]{3}[ .-][0-9]{4}$"), _n_digits(m) < 9),
        "secret": lambda m: (m.rlike(r"[\"':= ][A-Za-z0-9+/_=-]{16,}[\"']?$|^(?:AKIA|gh|xox|-----BEGIN)"), m.rlike(r"(?i)[\"':= ](?:example|changeme|none|null)")),
    }[kind]
    known = {
        "email": lambda m: (F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(DOMAINS), m.rlike(r"[0-9]$")),
        "ip": lambda m: (m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.") & ~m.rlike(r"^127\."), m.rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9])\.")),
        "card": lambda m: (_digits(m).rlike(ISSUERS), _digits(m).rlike(r"^[0789]")),
        "phone": lambda m: (m.rlike(COUNTRIES), m.rlike(r"^\+0")),
        "secret": lambda m: (m.rlike(r"[\"':= ](?:[0-9a-f]{32,}|[0-9A-Za-z+/_-]{24,}=*)[\"']?$|^(?:AKIA|gh|xox|-----BEGIN)"), m.rlike(r"[\"'][a-z]+[\"']$")),
    }[kind]

    def one(x: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), x["s"] - 39), F.least(F.lit(40), x["s"]))
        ok = strict(x["m"]) if strict else F.lit(False)
        votes = F.concat(_vote(ok, ~ok) if strict else F.lit("0"), _vote(*layout(x["m"])), _vote(*known(x["m"])), _vote((before.rlike(CONTEXT[kind])) if kind != "secret" else x["m"].rlike(CONTEXT[kind]), before.rlike(OTHER_USE)))
        size = F.least(F.lit(LENGTHS - 1), F.floor((x["e"] - x["s"]) / 8)).cast("string")
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), ok.alias("strict"), F.concat(F.lit(f"{kind} "), votes, F.lit(" "), size).alias("key"))

    return F.transform(found, one)


def candidates(text: Column) -> Column:
    """All candidates of a text by place: array<struct<kind, s, e, strict, key>>."""
    yes = lambda m: F.lit(True)
    at = F.contains(text, F.lit("@"))
    parts = [
        _labelled(_matches(text, EMAIL, at), "email", text, yes),
        _labelled(_matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), "ip", text, _octets),
        _labelled(F.filter(_matches(text, CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){13}")), lambda x: _n_digits(x["m"]).between(14, 19)), "card", text, _luhn),
        _labelled(_matches(text, PHONE, F.contains(text, F.lit("+")) & text.rlike(r"\+[0-9]")), "phone", text, lambda m: _n_digits(m).between(10, 15)),
        _labelled(_matches(text, SPELT, text.rlike(r"(?i)[(\[]at[)\]]")), "email", text),
        _labelled(_matches(text, LOCAL_PHONE, text.rlike(r"[0-9]{3}[ .-][0-9]{4}")), "phone", text),
        _labelled(_matches(text, SECRET, text.rlike(r"(?i)(?:token|secret|passw|key)")), "secret", text),
        _labelled(_matches(text, KEY, text.rlike("AKIA|gh[pousr]_|xox[abprs]-|PRIVATE KEY")), "secret", text),
    ]
    return F.concat(*parts)


def detect(docs: DataFrame, *, text_col: str = "text", out: str = "_candidates") -> DataFrame:
    """docs with their candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # texts without a digit, an address sign, a quotation mark, a bracket or a key's mark hold no candidate of any pattern
    any_ = text.rlike(r"[0-9@\"'\[(]|AKIA|gh[pousr]_|xox[abprs]-|PRIVATE KEY")
    kind = "array<struct<kind:string,s:int,e:int,strict:boolean,key:string>>"
    return docs.withColumn(out, F.when(any_, candidates(text)).otherwise(F.array().cast(kind)))


def fit(found: DataFrame, *, col: str = "_candidates", rounds: int = 60) -> list[str]:
    """The vote patterns (kind, votes, length) that the trained classifier accepts."""
    rows = found.where(F.size(col) > 0).select(F.explode(col).alias("c")).groupBy("c.key").agg(F.count(F.lit(1)).alias("n")).collect()
    cells = []
    for r in rows:
        kind, votes, size = r.key.split(" ")
        cells.append((kind, votes, int(size), r.n))
    found = classify(cells, expectation_maximisation(cells, rounds))
    return sorted(f"{k} {v} {s}" for k, v, s, p in found if p >= 0.5 and not _fails(k, v))


def _fails(kind: str, votes: str) -> bool:
    """A card number that fails its check digit counts only where words before it announce a card."""
    return kind == "card" and votes[0] == "-" and votes[3] != "+"


def expectation_maximisation(cells: list[tuple[str, str, int, int]], rounds: int) -> dict[tuple[str, str], float]:
    """Probability that a kind's pattern of votes is personal data.

    Two classes per kind; given the class, labelers vote independently.  It
    starts from the share of votes in favour, and a labeler is taken to be
    right more often than not, which fixes which class is which.  The first
    labeler, the strict pattern's check (a check digit above all), has a prior
    as heavy as half of all candidates for being right: what fails it is only
    taken up against that if the others together are surer.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({c[0] for c in cells}):
        hist: dict[str, int] = {}
        for k, votes, _, n in cells:
            if k == kind:
                hist[votes] = hist.get(votes, 0) + n
        total, width = sum(hist.values()), len(next(iter(hist)))
        heavy = {v: v + v[0] * 4 for v in hist}
        post = {v: (0.5 + h.count("+")) / (1 + h.count("+") + h.count("-")) for v, h in heavy.items()}
        for _ in range(rounds):
            prior = (sum(post[v] * n for v, n in hist.items()) + 1) / (total + 2)
            like = []
            for j in range(width):
                table = {}
                for y in (1, 0):
                    right = "+" if y else "-"
                    mass = {s: 1.0 + (s == right) * (1.0 + (0.5 * total if j == 0 else 0.0)) for s in "+-0"}
                    for v, n in hist.items():
                        mass[v[j]] += n * (post[v] if y else 1 - post[v])
                    norm = sum(mass.values())
                    table[y] = {s: m / norm for s, m in mass.items()}
                like.append(table)
            for v in hist:
                odds = math.log(prior) - math.log(1 - prior) + sum(math.log(like[j][1][v[j]]) - math.log(like[j][0][v[j]]) for j in range(width))
                post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out.update({(kind, v): p for v, p in post.items()})
    return out


def classify(cells: list[tuple[str, str, int, int]], post: dict[tuple[str, str], float], steps: int = 300) -> list[tuple[str, str, int, float]]:
    """Logistic regression on the soft labels: weights for each kind's votes and lengths."""
    weight: dict[tuple, float] = {}
    names = [[(k, "bias"), *((k, j, s) for j, s in enumerate(v)), (k, "length", size)] for k, v, size, _ in cells]
    scale: dict[str, float] = {}
    for k, _, _, n in cells:
        scale[k] = scale.get(k, 0) + n
    for _ in range(steps):
        grad: dict[tuple, float] = {}
        for (k, v, _, n), feats in zip(cells, names):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight.get(f, 0.0) for f in feats)))))
            for f in feats:
                grad[f] = grad.get(f, 0.0) + n / scale[k] * (post[k, v] - p)
        for f, g in grad.items():
            weight[f] = weight.get(f, 0.0) + g - 1e-4 * weight.get(f, 0.0)
    return [(k, v, size, 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight.get(f, 0.0) for f in feats)))))) for (k, v, size, _), feats in zip(cells, names)]


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed, without repeats."""
    order = F.create_map(*[F.lit(v) for k in KINDS for v in (k, KINDS.index(k))])
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.element_at(order, x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.array_sort(F.array_distinct(keyed))


def base_spans(found: Column) -> Column:
    return _ordered(F.filter(found, lambda x: x["strict"]))


def all_spans(found: Column, accepted: list[str]) -> Column:
    """Strict spans, and accepted loose ones that touch none of them."""
    allow = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<string>")
    strict = F.filter(found, lambda x: x["strict"])
    loose = F.filter(found, lambda x: ~x["strict"] & F.array_contains(allow, x["key"]) & ~F.exists(strict, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return _ordered(F.concat(strict, loose))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count of strict spans by kind, base_sha256 and spans of each row."""
    found = cut(detect(only(docs, id_col, text_col), text_col=text_col).select(F.col(id_col).alias("doc_id"), "_candidates"), "candidates")
    accepted = fit(found)
    with_ = found.withColumn("_base", base_spans(F.col("_candidates")))
    counts = [F.size(F.filter("_base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return with_.select("doc_id", *counts, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(all_spans(F.col("_candidates"), accepted)).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; other columns, and null texts, stay.

    Where spans overlap, the first covers the others as far as they go on.
    """
    found = cut(detect(docs.select(id_col, text_col), text_col=text_col).select("_candidates").where(F.size("_candidates") > 0), "candidates")
    accepted = fit(found)
    columns = docs.columns
    text = F.col(text_col)
    held, spans = free_names(columns, "_candidates", "_spans")
    with_ = detect(docs, text_col=text_col, out=held).withColumn(spans, all_spans(F.col(held), accepted))
    # what stands before a span begins where the farthest of those before it ends
    ends = F.aggregate(spans, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(F.greatest(F.element_at(out, -1), x["e"]))))
    gap = lambda at, x: F.substring(text, at + 1, F.greatest(F.lit(0), x["s"] - at))
    name = lambda at, x: F.when(x["s"] >= at, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
    parts = F.zip_with(F.slice(ends, F.lit(1), F.size(spans)), F.col(spans), lambda at, x: F.concat(gap(at, x), name(at, x)))
    masked = F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))
    return with_.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).select(*columns)
