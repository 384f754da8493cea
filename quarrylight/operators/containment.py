"""Which texts contain which others: a join on substrings without comparing all pairs.

A part is found in a whole only if all grams (stretches of LENGTHS characters) of the part
are grams of the whole. Every part is dealt by one gram alone, its rarest among the wholes,
of the longest length that the part has; wholes meet the parts of the grams that they hold
by equality, and what meets is compared. A part with a gram that no whole has meets none.
Parts of one or two characters are grams themselves, and the empty part is in every whole.

A whole's text is carried once, not once for a part: candidates are gathered as parts by
the whole's key and compared in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (1, 2, 3, 8)


def _grams(text: Column, n: int) -> Column:
    """All stretches of ``n`` characters; the empty gram, if it is 0."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) if n else F.array(F.lit(""))


def candidates(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """key, part: what ``contained`` compares. Wholes are cut into grams of those lengths alone that some part is dealt by."""
    length = F.lit(0)
    for n in LENGTHS:
        length = F.when(F.length("part") >= n, n).otherwise(length)
    own = parts.where("part IS NOT NULL").distinct().select("part", length.alias("length"))
    used = sorted(r[0] for r in own.select("length").distinct().collect())  # five at most
    none = F.array().cast("array<string>")
    long = none
    for n in used:
        long = F.when(F.col("length") == n, _grams(F.col("part"), n)).otherwise(long)
    needed = own.select("part", F.explode(F.array_distinct(long)).alias("gram"))
    every = F.array_distinct(F.concat(none, *(_grams(F.col("whole"), n) for n in used)))
    held = wholes.where("whole IS NOT NULL").select("key", F.explode(every).alias("gram")).join(needed.select("gram").distinct(), "gram", "left_semi")
    common = held.groupBy("gram").agg(F.count("*").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    anchors = needed.join(common, "gram", "left").groupBy("part").agg(F.min(order).alias("first")).where("first.n > 0").select("part", F.col("first.gram").alias("gram"))
    return held.join(anchors, "gram").select("key", "part")


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """key, part of all wholes (key, whole) and parts (part) that they contain, as they are written; each once. Keys are distinct."""
    met = candidates(parts, wholes).groupBy("key").agg(F.collect_set("part").alias("parts"))
    return wholes.join(met, "key").select("key", F.explode(F.filter("parts", lambda p: F.contains("whole", p))).alias("part"))
