"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Every document is measured by its words, lines and characters. A fixed base rule fails
documents that are short or repeat themselves; beyond it, thresholds follow the data:
each rule's measure is a whole number, whose distribution in every language and source
is kept as a quantile sketch, and a document fails where its measure lies beyond
``reach`` times the distance of the quartiles (``width`` of the rule, at least) outside
them.

The sketch is a histogram of log-linear buckets: a number keeps its ``BITS`` leading
bits, so that a quantile read from it is less than 1 / 2^(BITS - 1) of itself too low.
Sketches merge by adding the counts of equal buckets, in any order: tasks merge theirs
before the shuffle, those of sources make their language's, and those of languages make
the one of all. A source with fewer than ``least`` measured documents in a language takes
the language's thresholds, and a language with fewer takes those of all. A sketch has at
most some thousand buckets, however many documents it holds.

Measures are taken once and written without the texts; sketches and verdicts read them.

Defined cases: null text has no words, so it fails the base rule; documents without words
have no measures and enter no sketch; null is a language and a source of its own; rows that
share an identifier, or have none, are documents of their own; an empty table gives an empty
result; extra columns are ignored by ``quality_rules`` and kept by ``quality_filter``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

BITS = 7
_SPACE, _VISIBLE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A measure ``part * scale`` div ``whole``; width: the least distance of its quartiles; low: whether low values fail as well."""

    name: str
    part: str
    whole: str
    scale: int
    width: int
    low: bool = False


RULES = (
    Rule("word_length", "word_chars", "n_words", 1000, 400, low=True),
    Rule("symbol_share", "n_symbols", "n_words", 1_000_000, 30_000),
    Rule("dup_line_share", "n_dup_lines", "n_lines", 1_000_000, 130_000),
    Rule("repeat_share", "n_repeat_words", "n_words", 1_000_000, 100_000),
    Rule("capital_share", "n_capitals", "word_chars", 1_000_000, 50_000),
)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def _bound(value: Column, use) -> Column:
    """``use(value)``, where ``value`` is computed once although lambdas refer to it for every element."""
    return F.transform(F.array(value), use)[0]


def _covered(windows: Column, size: int) -> Column:
    """Places in windows that occur twice or more."""

    def places(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["w"] == x["w"]) | (F.get(ordered, i + 1)["w"] == x["w"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(x["i"], x["i"] + (size - 1))))))

    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return _bound(ordered, places)


def _repeated(words: Column, size: int = 3) -> Column:
    """Texts whose windows all have hashes of their own repeat nothing; those of others are compared as text."""

    def windows(w: Column, make) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))), lambda x, i: make(x, *(F.get(w, i + k) for k in range(1, size))))

    def of(w: Column) -> Column:
        apart = _bound(windows(w, F.xxhash64), lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when((F.size(w) <= size) | apart, 0).otherwise(_bound(windows(w, lambda *x: F.concat_ws(" ", *x)), lambda g: _covered(g, size)))

    return _bound(words, of)


def measured(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in ``_doc``, and COUNTS.

    n_words: runs other than white space. word_chars: code points in words. n_lines: lines with
    a word. n_dup_lines: those equal to an earlier one. n_repeat_words: words in windows of three
    words that the text has twice or more. n_symbols, n_capitals: characters of the two sets.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, _SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_VISIBLE))
    count = lambda kind: F.regexp_count(text, F.lit(kind))
    repeated = _bound(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    doubled = _bound(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    made = docs.select(
        F.struct("*").alias("_doc"),
        repeated.alias("_w"),
        doubled.alias("_l"),
        (F.length(text) - count(_SPACE)).alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count("[A-Z]").alias("n_capitals"),
    )
    return made.select("_doc", *(F.col({"n_words": "_w.n_words", "n_repeat_words": "_w.n_repeat_words", "n_lines": "_l.n_lines", "n_dup_lines": "_l.n_dup_lines"}.get(c, c)).cast("long").alias(c) for c in COUNTS))


def measure(rule: Rule) -> Column:
    """Null where there are no words."""
    return F.expr(f"CASE WHEN n_words > 0 THEN {rule.part} * {rule.scale}L div {rule.whole} END")


def bucket(x: str) -> str:
    """The smallest number with the leading bits of ``x``."""
    shift = f"greatest(length(bin({x})) - {BITS}, 0)"
    return f"shiftleft(shiftright({x}, {shift}), {shift})"


def sketches(counts: DataFrame) -> DataFrame:
    """level, lang, source, rule, bucket, n: level 0 for each language and source, 1 for each language, 2 for all."""
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), measure(r).alias("x")) for r in RULES))).alias("m")
    values = counts.select("lang", "source", each).where("m.x IS NOT NULL")
    base = values.groupBy("lang", "source", F.col("m.rule").alias("rule"), F.expr(bucket("m.x")).alias("bucket")).agg(F.count("*").alias("n"))
    return base.withColumn("level", F.lit(0))


def merged(base: DataFrame) -> DataFrame:
    """Sketches of sources, with those of languages and of all that they add up to."""
    nowhere = F.lit(None).cast("string")
    language = base.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    every = language.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    columns = ["level", "lang", "source", "rule", "bucket", "n"]
    return base.select(columns).unionByName(language.select(F.lit(1).alias("level"), "lang", nowhere.alias("source"), "rule", "bucket", "n")).unionByName(every.select(F.lit(2).alias("level"), nowhere.alias("lang"), nowhere.alias("source"), "rule", "bucket", "n"))


def quartiles(sketch: DataFrame) -> DataFrame:
    """level, lang, source, rule, n, q1, q3: the buckets that hold the ceil(n / 4)-th and the ceil(3 n / 4)-th value."""
    summed = sketch.selectExpr("*", "sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto", "sum(n) OVER (PARTITION BY level, lang, source, rule) AS total")
    at = lambda share: F.min(F.expr(f"CASE WHEN upto >= ceil(total * {share}D) THEN bucket END"))
    return summed.groupBy("level", "lang", "source", "rule").agg(F.max("total").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def thresholds(counts: DataFrame, scratch: Scratch, *, reach: int = 3, least: int = 30) -> DataFrame:
    """lang, source, level, then for each rule its <name>_low and <name>_high."""
    quarters = scratch.keep(quartiles(merged(scratch.keep(sketches(counts), "sketches"))), "quartiles")
    level = lambda k: quarters.where(F.col("level") == k).alias(f"l{k}")
    joined = level(0).join(level(1), F.expr("l0.lang <=> l1.lang AND l0.rule = l1.rule")).join(level(2), F.expr("l0.rule = l2.rule"))
    own = [F.expr(f"CASE WHEN l0.n >= {least} THEN l0.{c} WHEN l1.n >= {least} THEN l1.{c} ELSE l2.{c} END").alias(c) for c in ("level", "q1", "q3")]
    chosen = joined.select("l0.lang", "l0.source", "l0.rule", *own)
    width = F.create_map(*(F.lit(x) for r in RULES for x in (r.name, r.width)))[F.col("rule")]
    far = reach * F.greatest(F.col("q3") - F.col("q1"), width)
    bounds = chosen.select("lang", "source", "rule", "level", (F.col("q1") - far).alias("low"), (F.col("q3") + far).alias("high"))
    of = lambda r, c: F.max(F.when(F.col("rule") == r.name, F.col(c))).alias(f"{r.name}_{c}")
    return bounds.groupBy("lang", "source").agg(F.max("level").alias("level"), *(of(r, c) for r in RULES for c in ("low", "high")))


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {repeat_percent} * n_words")


def _judged(counts: DataFrame, bounds: DataFrame, min_words: int, repeat_percent: int) -> DataFrame:
    """``counts`` with base_failed, level, failed_rules and kept; ``bounds`` has a row for each language and source."""
    joined = counts.alias("c").join(bounds.alias("b"), F.expr("c.lang <=> b.lang AND c.source <=> b.source"), "left")
    beyond = [F.when((measure(r) > F.col(f"b.{r.name}_high")) | (F.lit(r.low) & (measure(r) < F.col(f"b.{r.name}_low"))), F.lit(r.name)) for r in RULES]
    judged = joined.select("c.*", base_failed(min_words, repeat_percent).alias("base_failed"), "b.level", F.concat_ws(",", *beyond).alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def quality_rules(docs: DataFrame, *, reach: int = 3, least: int = 30, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, level (of the thresholds: 0 the source's own, 1 the language's, 2 of all), failed_rules, kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.keep(measured(docs.select("doc_id", "text", "lang", "source")).select("_doc.doc_id", "_doc.lang", "_doc.source", *COUNTS), "counts")
    bounds = scratch.keep(thresholds(counts, scratch, reach=reach, least=least), "bounds")
    return _judged(counts, bounds, min_words, repeat_percent)


def quality_filter(docs: DataFrame, *, reach: int = 3, least: int = 30, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, whole; texts are measured again and not shuffled, unless the thresholds are too many to broadcast."""
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.keep(measured(docs.select("text", "lang", "source")).select("_doc.lang", "_doc.source", *COUNTS), "counts")
    bounds = scratch.keep(thresholds(counts, scratch, reach=reach, least=least), "bounds")
    again = measured(docs).select("_doc", "_doc.lang", "_doc.source", *COUNTS)
    return _judged(again, bounds, min_words, repeat_percent).where("kept").select("_doc.*")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", "level", "failed_rules")


def _sql() -> str:
    rules = [f"SELECT *, '{r.name}' AS rule, {r.part} * {r.scale} // {r.whole} AS x, {r.width} AS width, {str(r.low).lower()} AS two_sided FROM counts WHERE n_words > 0" for r in RULES]
    return rf"""
        WITH base AS (
            SELECT *, row_number() OVER () AS place, coalesce(text, '') AS t FROM documents
        ), split AS (
            SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM base
        ), grams AS (
            SELECT place, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT place, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 2)
        ), twice AS (
            SELECT place, i FROM grams QUALIFY count(*) OVER (PARTITION BY place, g) > 1
        ), covered AS (
            SELECT place, count(DISTINCT p) AS n FROM (SELECT place, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY place
        ), counts AS (
            SELECT s.place, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
                   coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
            FROM split s LEFT JOIN covered c USING (place)
        ), measures AS (
            {" UNION ALL ".join(rules)}
        ), bucketed AS (
            SELECT *, (x >> greatest(length(bin(x)) - {BITS}, 0)) << greatest(length(bin(x)) - {BITS}, 0) AS bucket FROM measures
        ), sketches AS (
            SELECT 0 AS level, lang, source, rule, bucket, count(*) AS n FROM bucketed GROUP BY ALL
            UNION ALL SELECT 1, lang, NULL, rule, bucket, count(*) FROM bucketed GROUP BY ALL
            UNION ALL SELECT 2, NULL, NULL, rule, bucket, count(*) FROM bucketed GROUP BY ALL
        ), summed AS (
            SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM sketches
        ), quarters AS (
            SELECT level, lang, source, rule, max(total) AS n, min(bucket) FILTER (WHERE upto >= ceil(total * 0.25)) AS q1, min(bucket) FILTER (WHERE upto >= ceil(total * 0.75)) AS q3
            FROM summed GROUP BY ALL
        ), chosen AS (
            SELECT m.place, m.rule, m.x, m.width, m.two_sided, CASE WHEN a.n >= 30 THEN 0 WHEN b.n >= 30 THEN 1 ELSE 2 END AS lev,
                   CASE WHEN a.n >= 30 THEN a.q1 WHEN b.n >= 30 THEN b.q1 ELSE c.q1 END AS low, CASE WHEN a.n >= 30 THEN a.q3 WHEN b.n >= 30 THEN b.q3 ELSE c.q3 END AS high
            FROM measures m
            JOIN quarters a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source AND a.rule = m.rule
            JOIN quarters b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM m.lang AND b.rule = m.rule
            JOIN quarters c ON c.level = 2 AND c.rule = m.rule
        ), beyond AS (
            SELECT *, x > high + 3 * greatest(high - low, width) OR (two_sided AND x < low - 3 * greatest(high - low, width)) AS fails FROM chosen
        ), groups AS (
            SELECT lang, source, max(lev) AS level FROM beyond JOIN counts USING (place) GROUP BY ALL
        ), verdicts AS (
            SELECT place, string_agg(rule, ',' ORDER BY list_position({[r.name for r in RULES]}, rule)) FILTER (WHERE fails) AS failed
            FROM beyond GROUP BY place
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND failed IS NULL AS kept, n_lines, n_capitals, g.level, coalesce(failed, '') AS failed_rules
        FROM counts s LEFT JOIN verdicts USING (place)
        LEFT JOIN groups g ON g.lang IS NOT DISTINCT FROM s.lang AND g.source IS NOT DISTINCT FROM s.source
    """


SQL = {"op13_quality_rules": _sql()}
