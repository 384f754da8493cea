"""Two-stage ranking of skills for tasks, and of learnings.

skills: name, relative_path, title, intent, description, triggers, action_triggers,
micro_rules, keywords, content. tasks: query_id, text. Weights are columns of one
expression, so a batch of tasks is one join and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sigmoid, trimmed
from ..functions.vectors import cosine, dot
from ..session import shared_folder
from .containment import candidates

# Weights of a whole query and of each of its words, by the field that holds it.
QUERY_WEIGHTS = {"intent": 0.6, "description": 0.4, "triggers": 0.5, "actions": 0.6}
WORD_WEIGHTS = {"name": 0.4, "actions": 0.35, "intent": 0.25, "triggers": 0.25, "rules": 0.2, "description": 0.15, "keywords": 0.2, "content": 0.05}
VECTOR_WORD_WEIGHTS = {"name": 0.1, "actions": 0.12, "intent": 0.08}
FALLBACK_WORD_WEIGHTS = {"actions": 0.2, "intent": 0.15, "triggers": 0.15, "rules": 0.1, "description": 0.1, "keywords": 0.1, "content": 0.03}
# Words of skills that suit any project, and of those bound to a language or a technique.
UNIVERSAL = ["workflow", "guidance", "agent", "flow", "test", "review", "git", "cost", "media", "doc"]
LANGUAGE_WORDS = [
    ("rust", "rust"), ("python", "python"), ("javascript", "javascript"), ("typescript", "typescript"), ("go", "go"), ("golang", "go"),
    ("java", "java"), ("cpp", "c++"), ("c++", "c++"), ("ruby", "ruby"), ("php", "php"),
]
DOMAIN_WORDS = ["database", "sql", "docker", "devops", "frontend", "web", "bash", "shell"]
RERANKED, LEAST, NAMED = 8, 0.35, 0.5


def fields() -> dict[str, Column]:
    """Lower-cased text of each field that is searched."""
    joined = {"triggers": "triggers", "actions": "action_triggers", "rules": "micro_rules", "keywords": "keywords"}
    plain = {k: F.lower(F.coalesce(F.col(k), F.lit(""))) for k in ("name", "intent", "description", "content")}
    return plain | {k: F.lower(F.coalesce(F.array_join(c, " "), F.lit(""))) for k, c in joined.items()}


def words(text: Column) -> Column:
    """White-space separated words of the lower-cased text; repeats count again."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _cents(weight: float) -> int:
    """Weights add up as whole hundredths, so that equal scores are equal whatever the order of their parts."""
    return round(100 * weight)


def _word_score(query: Column, weights: dict[str, float], own: dict[str, Column]) -> Column:
    """Sum, in hundredths, over the words of a query and the fields that contain each."""

    def of(w: Column) -> Column:
        score = F.lit(0)
        for field, weight in weights.items():
            score = score + F.when(F.contains(own[field], w), _cents(weight)).otherwise(0)
        return score

    return F.aggregate(words(query), F.lit(0), lambda s, w: s + of(w))


def _has(text: Column, part: Column) -> Column:
    return (text != "") & F.contains(text, part)


def lexical_score(query: Column) -> Column:
    """First stage without vectors."""
    own, q = fields(), F.lower(query)
    score = F.when(own["name"] == q, 100).when(F.contains(own["name"], q), 70).otherwise(0)
    for field, weight in QUERY_WEIGHTS.items():
        score = score + F.when(_has(own[field], q), _cents(weight)).otherwise(0)
    return (score + _word_score(query, WORD_WEIGHTS, own)) / 100.0


def vector_score(query: Column, query_vector: Column, vector: Column) -> Column:
    """First stage with vectors: their product and lexical boosts."""
    own, q = fields(), F.lower(query)
    named = F.when(own["name"] == q, 0.5).when(F.contains(own["name"], q), 0.3).when(F.contains(own["intent"], q), 0.25).otherwise(0.0)
    return dot(query_vector, vector) + named + _word_score(query, VECTOR_WORD_WEIGHTS, own) / 100.0


def stage_one(skills: DataFrame, tasks: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """The ``k`` best skills of each task; of lexical scores only those above 0, unless the task is blank.

    Lexical scores are computed for candidates alone (``lexical_candidates``), which hold the
    best ones of every text; another ``score`` is computed for all skills, in blocks.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "name")
    if score is None:
        keyed = skills.withColumn("_skill", _key(skills))
        named = lexical_candidates(skills, tasks, k)
        pairs = named.join(tasks, "text").join(keyed, "_skill").drop("_skill").withColumn("score", lexical_score(F.col("text")))
        pairs = pairs.where((F.col("score") > 0) | (trimmed("text") == "")).select(*skills.columns, *tasks.columns, "score")
    else:
        pairs = spread(skills, tasks).withColumn("score", score)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _key(rows: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct("*")).cast("binary"))


def _met(skills: DataFrame, parts: DataFrame, names: list[str]) -> DataFrame:
    """_skill, part, shown and the fields ``names`` of skills that may contain a part (part) in one of them.

    The fields of a skill are looked at together, as one text, so that what they share counts
    once; which of them contain a part is left to the row.
    """
    own = [fields()[f].alias(f"_{f}") for f in names]
    keyed = skills.select(_key(skills).alias("_skill"), F.col("name").alias("shown"), *own).dropDuplicates(["_skill"])
    together = keyed.select(F.col("_skill").alias("key"), F.concat_ws("\0", *(f"_{f}" for f in names)).alias("whole"))
    met = candidates(parts, together).groupBy(F.col("key").alias("_skill")).agg(F.collect_set("part").alias("parts"))
    return keyed.join(met, "_skill").withColumn("part", F.explode("parts")).drop("parts")


def word_points(skills: DataFrame, tasks: DataFrame) -> DataFrame:
    """_skill, name, word, points: what every word of the tasks adds to the score of each skill that has it, in hundredths."""
    parts = tasks.select(F.explode(words(F.col("text"))).alias("part")).distinct()
    points = F.lit(0)
    for field, weight in WORD_WEIGHTS.items():
        points = points + F.when(F.contains(F.col(f"_{field}"), F.col("part")), _cents(weight)).otherwise(0)
    hits = _met(skills, parts, list(WORD_WEIGHTS)).select("_skill", F.col("part").alias("word"), points.cast("long").alias("points"), F.col("shown").alias("name"))
    return hits.where("points > 0")


def _whole_query(skills: DataFrame, texts: DataFrame) -> DataFrame:
    """text, _skill, name, bonus where the name or a weighted field contains the whole lower-cased text; bonus: what that adds, in hundredths."""
    own = [f for f in fields() if f == "name" or f in QUERY_WEIGHTS]
    lowered = texts.select("text", F.lower("text").alias("part"))
    name, part = F.col("_name"), F.col("part")
    bonus, hit = F.when(name == part, 100).when(F.contains(name, part), 70).otherwise(0), F.lit(False)
    for field in own:
        hit = hit | F.contains(F.col(f"_{field}"), part)
        if field in QUERY_WEIGHTS:
            bonus = bonus + F.when(_has(F.col(f"_{field}"), part), _cents(QUERY_WEIGHTS[field])).otherwise(0)
    found = _met(skills, lowered.select("part"), own).where(hit).select("_skill", F.col("shown").alias("name"), "part", bonus.cast("long").alias("bonus"))
    return found.join(lowered, "part").select("text", "_skill", "name", "bonus")


def lexical_candidates(skills: DataFrame, tasks: DataFrame, k: int) -> DataFrame:
    """text, _skill: for every distinct text of tasks a set of skills that holds its ``k`` best.

    Of skills that contain the whole text, the ``k`` with the best scores are candidates. The
    score of any other is the sum of its words' points, which is bounded by the most that each
    word gives to any skill:

    * those ``k`` and the ``k`` skills that each word gives most to make whole and partial
      scores, of which the k-th best is a threshold that the k-th best score reaches;
    * a skill is looked for by the rarest of the text's words that it has, so all its other
      words are more common ones; of a word are looked up only skills to which it gives enough
      to reach the threshold, if all more common words gave their most; if just enough, those
      whose names come early enough.

    Points of words and skills with the whole text are written once to the shared folder; a blank text has the skills
    with the first ``k`` names besides.
    """
    spark = skills.sparkSession
    texts = tasks.select("text").where("text IS NOT NULL").distinct()
    path = shared_folder(spark, "points")
    word_points(skills, texts).write.parquet(path)
    points = spark.read.schema("_skill string, word string, points long, name string").parquet(path)
    asked = texts.select("text", F.explode(words(F.col("text"))).alias("word")).groupBy("text", "word").agg(F.count("*").alias("m"))
    most = points.groupBy("word").agg(F.max("points").alias("most"), F.count("*").alias("n"))
    best = points.withColumn("_n", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("points"), "name", "_skill"))).where(F.col("_n") <= k).drop("_n")
    whole = f"{path}-whole"
    _whole_query(skills, texts).write.parquet(whole)
    having = spark.read.schema("text string, _skill string, name string, bonus long").parquet(whole)
    worth = having.join(asked, "text", "left").join(points.select("_skill", "word", "points"), ["_skill", "word"], "left")
    scores = worth.groupBy("text", "_skill", "name", "bonus").agg(F.sum(F.coalesce(F.col("m") * F.col("points"), F.lit(0))).alias("sum")).select("text", "_skill", "name", (F.col("bonus") + F.col("sum")).alias("sum"))
    first = Window.partitionBy("text").orderBy(F.desc("sum"), "name", "_skill")
    leading = scores.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    some = asked.join(best, "word").groupBy("text", "_skill", "name").agg(F.sum(F.col("m") * F.col("points")).alias("sum"))
    partial = some.unionByName(leading).groupBy("text", "_skill", "name").agg(F.max("sum").alias("sum"))
    placed = partial.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    least = placed.where(F.col("_n") == k).select("text", F.col("sum").alias("least"), F.col("name").alias("last"))
    known = asked.join(most, "word").withColumn("gives", F.col("m") * F.col("most"))
    upto = Window.partitionBy("text").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)
    bound = known.join(least, "text", "left").withColumn("upto", F.sum("gives").over(upto))
    looked_up = bound.where("least IS NULL OR upto >= least").select("text", "word", "m", "last", (F.col("least") - F.col("upto") + F.col("gives")).alias("need"))
    given = F.col("m") * F.col("points")
    enough = F.col("need").isNull() | (given > F.col("need")) | ((given == F.col("need")) & (F.col("name") <= F.col("last")))
    found = looked_up.join(points, "word").where(enough).select("text", "_skill")
    blank = texts.where(trimmed("text") == "")
    early = [r["_skill"] for r in skills.select(_key(skills).alias("_skill"), "name").orderBy("name", "_skill").limit(k).collect()]  # k keys
    named = blank.select("text", F.explode(F.array(*map(F.lit, early)).cast("array<string>")).alias("_skill"))
    return found.unionByName(leading.select("text", "_skill")).unionByName(named).distinct()


def spread(rows: DataFrame, queries: DataFrame, salts: int = 16) -> DataFrame:
    """Every row with every query of a stated set, in blocks: rows are dealt to salts by all of their columns, queries go to all of them."""
    a = rows.withColumn("_salt", F.pmod(F.xxhash64(*(c for c, kind in rows.dtypes if not kind.startswith("map"))), F.lit(salts)).cast("int"))
    b = queries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, "_salt").drop("_salt")


def affinity(task: Column, languages: Column, techniques: Column) -> Column:
    """Whether a skill suits a project: named in the task, universal, or bound to what the project has."""
    name, path = F.lower("name"), F.lower("relative_path")

    def mentions(word: str) -> Column:
        return F.contains(name, F.lit(word)) | F.contains(path, F.lit(word))

    universal = F.lit(False)
    for word in UNIVERSAL:
        universal = universal | mentions(word)
    bound = F.array_compact(F.array(*(F.when(mentions(w), F.lit(lang)) for w, lang in LANGUAGE_WORDS)))
    language = (F.size(bound) == 0) | (F.size(languages) == 0) | F.arrays_overlap(bound, languages)
    domains = F.array_compact(F.array(*(F.when(mentions(w), F.lit(w)) for w in DOMAIN_WORDS)))
    domain = (F.size(techniques) == 0) | (F.size(F.array_except(domains, techniques)) == 0)
    return F.when(F.contains(F.lower(task), name), True).when(universal, True).otherwise(language & domain)


def rerank(candidates: DataFrame, logit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Second stage with a pair model: the first eight of each task, kept at 0.35 or more.

    logit: adds a column of that name to (query_id, text, name, content, ...). If all fall below, a task has no result.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    first = candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= RERANKED).drop("_n")
    named = F.when(F.contains(F.lower("text"), F.lower("name")), NAMED).otherwise(0.0)
    scored = logit(first).withColumn("probability", sigmoid(F.col("logit")) + named)
    return scored.where(F.col("probability") >= LEAST)


def fallback_score(base: Column, query: Column) -> Column:
    """Second stage without a model."""
    own = fields()
    names = F.aggregate(words(query), F.lit(0), lambda s, w: s + F.when(own["name"] == w, 30).when(F.contains(own["name"], w), 15).otherwise(0))
    return base + (names + _word_score(query, FALLBACK_WORD_WEIGHTS, own)) / 100.0


def stage_two(candidates: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("final"), "name")
    own = candidates.withColumn("final", fallback_score(F.col("score"), F.col("text")))
    return own.withColumn("final_rank", F.row_number().over(w))


def recency(learnings: DataFrame) -> DataFrame:
    """Adds recency, (place + 1) / count in order of ``ord``, within ``owner`` if there is one."""
    keys = ["owner"] if "owner" in learnings.columns else []
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return learnings.withColumn("recency", F.row_number().over(w.orderBy("ord")) / F.count("*").over(w))


def rank_learnings(learnings: DataFrame, query: Column, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """0.8 similarity + 0.2 recency of learnings with a vector, those whose similarity reaches the threshold."""
    own = recency(learnings).withColumn("similarity", cosine(F.col("vector"), query))
    scored = own.where(F.col("similarity") >= threshold).withColumn("score", 0.8 * F.col("similarity") + 0.2 * F.col("recency"))
    return scored.orderBy(F.desc("score"), F.desc("ord")).limit(k)
