"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers they miss.

Base spans come from four regular expressions, written so that Java runs them in linear time and constant stack
(possessive, started only where a match can start), leftmost and non-overlapping per kind. Lengths of
the pieces between matches, summed per document, give positions in code points.

Bootstrapping: the words before a base match are its lexical patterns (one word, two words). Candidates are tokens with a
digit or ``@`` that no base span overlaps; a leading ``name=`` or ``name:`` is their left word. Over the graph of
patterns and candidates, per kind,

    confidence(pattern) = (seeds + sum of the scores of its candidates) / (all its instances + 1)
    score(candidate)    = highest confidence among its patterns

is repeated ``ROUNDS`` times, counting distinct instances. A pattern takes part with at least ``MIN_SEEDS`` distinct seeds of
the kind, and only where it could reach ``CONFIDENCE``; so common words drop out before
the iteration. Candidates that reach it become spans of the kind.

Everything is DataFrame functions, without Python. Texts are read once; from then on rows are matches.

Defined results: null and empty texts have no spans; rows with equal or null ids are searched row by row; equal spans of two
kinds are both listed; an empty table gives an empty result; only ``doc_id`` and ``text`` are read. Candidates are at most
``CANDIDATE_CHARS`` long, which is what an identifier is here; texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.scratch import write_table

KINDS = ("email", "ip", "card", "phone")
CANDIDATE = len(KINDS)
OWN = -1  # a document's own row

LOCAL = "[A-Za-z0-9._%+-]"
BLANK = r"\x20\x09-\x0D"
#: In the order of ``KINDS``, then candidates. ``\G`` is where the last match ended.
PATTERNS = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<![^{BLANK}])[^{BLANK}0-9@]*+[0-9@][^{BLANK}]*+",
)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TRIM = " .,;:!?()[]{}<>\"'=*#`"

MIN_SEEDS = 5
CONFIDENCE = 0.7
ROUNDS = 3
CANDIDATE_CHARS = 64
CONTEXT_CHARS = 80


def luhn(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    one_by_one = F.transform(F.split(F.reverse(digits), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(one_by_one, lambda x, i: F.when(i % 2 == 0, x).otherwise(
        2 * x - F.when(x > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == 2, F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(kind == 3, n.between(9, 15))
        .otherwise(F.lit(False))
    )


def _found(docs: DataFrame) -> DataFrame:
    """A row per match of every pattern, with the length of the gap before it, and a row per document."""
    text = F.col("text")
    could = (
        F.contains(text, F.lit("@")), text.rlike("[0-9]"), text.rlike("[0-9]"), F.contains(text, F.lit("+")),
        text.rlike("[0-9@]"))
    nothing = F.array().cast("array<string>")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    matched = rows.select("row", "doc_id", "text", *[
        F.when(may, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(nothing).alias(f"m{k}")
        for k, (p, may) in enumerate(zip(PATTERNS, could))])
    cut = matched.select("row", "doc_id", *[f"m{k}" for k in range(len(PATTERNS))], *[
        F.when(F.size(f"m{k}") > 0, F.split(text, p, -1)).otherwise(nothing).alias(f"p{k}")
        for k, p in enumerate(PATTERNS)])
    none = F.struct(
        F.lit(OWN).alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("gap"), F.lit("").alias("match"),
        F.lit("").alias("left"))

    def listed(k: int) -> Column:
        matches, pieces = F.col(f"m{k}"), F.col(f"p{k}")
        return F.transform(matches, lambda m, i: F.struct(
            F.lit(k).alias("kind"), i.alias("nth"), F.length(F.get(pieces, i)).alias("gap"), m.alias("match"),
            F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)).alias("left")))

    return cut.select("row", "doc_id", F.explode(F.concat(F.array(none), *[listed(k) for k in range(len(PATTERNS))])).alias("w")
                      ).select("row", "doc_id", "w.*")


def occurrences(docs: DataFrame) -> DataFrame:
    """Valid base spans, candidates outside them and one row per document, as a work table."""
    # all windows are by document
    rows = _found(docs).repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("match").cast("long")
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + length).over(upto)).withColumn("start", F.col("end") - length)
    rows = rows.where((F.col("kind").isin(OWN, CANDIDATE)) | _valid(F.col("kind"), F.col("match")))
    is_base = F.col("kind").between(0, CANDIDATE - 1)
    order = Window.partitionBy("row").orderBy("start", F.col("kind") == CANDIDATE, "end")
    rows = rows.withColumn("_before", F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_after", F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)))
    overlaps = (F.coalesce("_before", F.lit(-1)) > F.col("start")) | (F.coalesce("_after", F.lit(1 << 62)) < F.col("end"))
    rows = rows.where((F.col("kind") != CANDIDATE) | ~overlaps).drop("_before", "_after", "gap", "nth")
    # a candidate loses its name and the punctuation around it
    named = F.regexp_extract("match", "^[A-Za-z_-]{1,40}[=:]", 0)
    is_candidate = F.col("kind") == CANDIDATE
    body = F.expr("substring(match, length(_name) + 1)")
    rows = rows.withColumn("_name", F.when(is_candidate, named).otherwise(F.lit("")))
    rows = rows.withColumn("_inner", F.ltrim(body, F.lit(TRIM)))
    rows = rows.withColumn("_core", F.rtrim(F.col("_inner"), F.lit(TRIM)))
    start = F.col("start") + F.length("match") - F.length("_inner")
    rows = rows.select(
        "row", "doc_id", "kind", F.when(is_candidate, start).otherwise(F.col("start")).alias("start"),
        F.when(is_candidate, start + F.length("_core")).otherwise(F.col("end")).alias("end"),
        F.when(is_candidate, F.col("_core")).otherwise(F.col("match")).alias("value"),
        F.concat("left", F.lit(" "), "_name").alias("left"))
    keeps = F.length("value").between(2, CANDIDATE_CHARS) & F.col("value").rlike("[0-9@]")
    return write_table(rows.where((F.col("kind") != CANDIDATE) | keeps), "matches")


def _patterns(rows: DataFrame) -> DataFrame:
    """``pattern``, ``kind`` and ``value``, once per distinct instance."""
    words = F.filter(F.split(F.lower("left"), f"[{BLANK}]+"), lambda w: F.length(F.btrim(w, F.lit(TRIM))) > 0)
    words = F.transform(words, lambda w: F.btrim(w, F.lit(TRIM)))
    both = rows.select("kind", F.lower("value").alias("value"), words.alias("_w"))
    last, second = F.element_at("_w", -1), F.concat(F.element_at("_w", -2), F.lit(" "), F.element_at("_w", -1))
    listed = F.when(F.size("_w") > 1, F.array(last, second)).when(F.size("_w") == 1, F.array(last)).otherwise(
        F.array().cast("array<string>"))
    return both.select("kind", "value", F.explode(listed).alias("pattern")).distinct()


def discovered(matches: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE,
               rounds: int = ROUNDS) -> DataFrame:
    """``(value, kind)``: candidates that high-confidence patterns point to, with the kind they point to most."""
    is_candidate = F.col("kind") == CANDIDATE
    graph = _patterns(matches.where("kind >= 0"))
    counts = graph.groupBy("pattern").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"s{k}") for k in range(CANDIDATE + 1)])
    total = sum(F.col(f"s{k}") for k in range(CANDIDATE + 1))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("seeds")) for k in range(CANDIDATE)])
    useful = (
        counts.where(F.col(f"s{CANDIDATE}") > 0)
        .select(F.col("pattern").alias("_p"), total.alias("total"), F.col(f"s{CANDIDATE}").alias("open"), F.explode(kinds).alias("_k"))
        .select("_p", "total", "_k.*", "open")
        .where((F.col("seeds") >= min_seeds) & (F.col("seeds") + F.col("open") >= confidence * (F.col("total") + 1)))
        .withColumn("conf", F.col("seeds") / (F.col("total") + 1))
    )
    edges = write_table(
        graph.where(is_candidate).select("pattern", "value").join(useful, F.col("pattern") == F.col("_p"))
        .select("pattern", "value", "kind", "seeds", "total", "conf"), "patterns")
    if edges.isEmpty():
        return edges.select("value", "kind")
    for _ in range(rounds):
        score = edges.groupBy("value", "kind").agg(F.max("conf").alias("score"))
        scored = edges.drop("conf").join(score, ["value", "kind"])
        again = scored.groupBy("pattern", "kind").agg(
            ((F.first("seeds") + F.sum("score")) / (F.first("total") + 1)).alias("conf"))
        edges = scored.drop("score").join(again, ["pattern", "kind"])
    best = edges.groupBy("value").agg(F.max(F.struct(F.col("conf"), (-F.col("kind")).alias("k"))).alias("best"))
    return best.where(F.col("best.conf") >= confidence).select("value", (-F.col("best.k")).alias("kind"))


def personal_data(docs: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE,
                  rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256``, ``spans`` and ``n_found`` (spans that the base missed)."""
    matches = occurrences(docs)
    found = discovered(matches, min_seeds, confidence, rounds).select(
        F.col("value").alias("_value"), F.col("kind").alias("_kind"))
    base = matches.where(F.col("kind") != CANDIDATE).select("row", "doc_id", "kind", "start", "end", F.lit(False).alias("new"))
    new = matches.where(F.col("kind") == CANDIDATE).join(found, F.lower("value") == F.col("_value")).select(
        "row", "doc_id", F.col("_kind").alias("kind"), "start", "end", F.lit(True).alias("new"))
    name = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("shown"))
    is_span, is_base = F.col("kind") >= 0, ~F.col("new")

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(of), lambda s: s["shown"]), ",")

    out = base.unionByName(new).groupBy("row", "doc_id").agg(
        *[F.count(F.when((F.col("kind") == k) & is_base, 1)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.collect_list(F.when(is_span & is_base, span)).alias("_base"),
        F.collect_list(F.when(is_span, span)).alias("_all"),
        F.count(F.when(~is_base, 1)).alias("n_found"))
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.col("_all")).alias("spans"), "n_found")
