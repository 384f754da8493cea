"""The driver's tables in the roles of the library's own, as DataFrames and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACES, lines_of
from ..operators.chunks import query_terms
from ..session import table

AS_OF = "2024-01-30 12:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls: the event type is the tool, props give the operation (null for a third), the value tokens."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    raw = table(spark, sf_dir, "events")
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.col("event_type").alias("tool_name"),
        F.when(k % 3 != 0, F.concat(F.lit("op"), (k % 3).cast("string"))).alias("operation"),
        F.floor(F.col("value") * 100).cast("long").alias("tokens_original"),
        F.floor(F.col("value") * ((F.col("event_id") % 10) + 1) * 10).cast("long").alias("tokens_optimized"),
        F.when(F.col("event_type") == "error", "failed").alias("error_message"),
    )


EVENTS = r"""calls AS (
    SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type AS tool_name,
           CASE WHEN CAST(regexp_extract(props, '(\d+)', 1) AS INT) % 3 <> 0
                THEN 'op' || CAST(CAST(regexp_extract(props, '(\d+)', 1) AS INT) % 3 AS VARCHAR) END AS operation,
           CAST(floor(value * 100) AS BIGINT) AS tokens_original,
           CAST(floor(value * ((event_id % 10) + 1) * 10) AS BIGINT) AS tokens_optimized,
           CASE WHEN event_type = 'error' THEN 'failed' END AS error_message
    FROM events)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, term: the distinct tokens of every benchmark text."""
    return query_terms(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), F.col("text"))


TERMS = r"""terms AS (
        SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark)"""


INDEX = r"""idx AS (
    SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)"""


def match_sql(index: str, keys: str, name: str) -> str:
    """Units of an index that hold all terms of a query."""
    own = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    return f"""{name} AS (
        SELECT f.query_id, {own} FROM (SELECT t.query_id, {keys}, count(*) AS n FROM {index} i JOIN terms t ON i.term = t.term GROUP BY ALL) f
        JOIN (SELECT query_id, count(*) AS n FROM terms GROUP BY query_id) w ON f.query_id = w.query_id AND f.n = w.n)"""


LINES = "list_transform(CASE WHEN right(coalesce(text, ''), 1) IN ('', chr(10)) THEN string_split(coalesce(text, ''), chr(10))[:-2] ELSE string_split(coalesce(text, ''), chr(10)) END, lambda x: rtrim(x, chr(13)))"


def trim_sql(text: str) -> str:
    """Without white space of any kind at either end."""
    return f"trim({text}, '{SPACES}')"


#: Lines of code that lines of prose become in turn; {a} and {b} are the first and last word of the line, x if it has none.
CODE_FORMS = [
    "\tuse {a}::{b};", "pub fn {a}() {", "\t{b}({a});", "}", "\tdef {b}({a}):", "\t\treturn get_{a}({b})", "class {a} {", "    {a}: {b},", "\t ", "}} // {a}", "fn {b}(", "\u00a0\tto: {a}) {",
]


def _parts(form: str) -> list[str]:
    """Text and names of words in turn."""
    return re.split(r"\{([ab])\}", form)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: every document as a file of code, each of its lines as the next of CODE_FORMS."""

    def rewritten(line: Column, i: Column) -> Column:
        low, word = F.lower(line), r"[\p{L}\p{N}]"
        part = {"a": F.regexp_extract(F.concat(low, F.lit(" x")), f"({word}+)", 1), "b": F.regexp_extract(F.concat(F.lit("x "), low), rf"(?s)\A.*(?<!{word})({word}+)", 1)}  # looked for from either end
        made = F.lit(None).cast("string")
        for turn, form in reversed(list(enumerate(CODE_FORMS))):
            made = F.when(i % len(CODE_FORMS) == turn, F.concat(*(part[p] if k % 2 else F.lit(p) for k, p in enumerate(_parts(form))))).otherwise(made)
        return made

    path = F.concat(F.lit("src/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".rs"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.array_join(F.transform(lines_of(F.col("text")), rewritten), "\n").alias("content"))


def _form_sql(form: str) -> str:
    word = {"a": "w[1]", "b": "w[2]"}
    return " || ".join(word[p] if k % 2 else "'" + p + "'" for k, p in enumerate(_parts(form)) if p)


_TURNS = " ".join(f"WHEN {k} THEN {_form_sql(f)}" for k, f in enumerate(CODE_FORMS))
CODE = rf"""prose AS (SELECT 'src/' || coalesce(source, '') || '/' || doc_id || '.rs' AS path, list_transform({LINES}, lambda x: regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+')) AS lines FROM documents),
    files AS (SELECT path, array_to_string(list_transform(list_transform(lines, lambda t: [coalesce(t[1], 'x'), coalesce(t[-1], 'x')]), lambda w, i: CASE (i - 1) % {len(CODE_FORMS)} {_TURNS} END), chr(10)) AS text FROM prose),
    rows AS (SELECT path, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS line_no FROM files)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """source (supplier), target (order or part): of all lines; repeated ones only for callers that count distinct ends themselves."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    targets = F.array(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    every = lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.explode(targets).alias("target"))
    return every.distinct() if distinct else every


EDGES = """edges AS (
    SELECT DISTINCT 's' || l_suppkey AS source, unnest(['o' || l_orderkey, 'p' || l_partkey]) AS target FROM lineitem)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, file_path of suppliers (in their nation), parts (in their brand) and orders (in their status)."""
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("file_path"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("brand/"), "p_brand").alias("file_path"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.concat(F.lit("status/"), "o_orderstatus").alias("file_path"))
    return suppliers.unionByName(parts).unionByName(orders)


SYMBOLS = """symbols AS (
    SELECT 's' || s_suppkey AS id, s_name AS name, 'nation/' || s_nationkey AS file_path FROM supplier
    UNION ALL SELECT 'p' || p_partkey, p_name, 'brand/' || p_brand FROM part
    UNION ALL SELECT 'o' || o_orderkey, 'order ' || o_orderkey, 'status/' || o_orderstatus FROM orders)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What searches resolved to: the event type is the term, the user the path; odd events name a symbol and a line."""
    odd = F.col("event_id") % 2 == 1
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("alias_term"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("resolved_path"),
        F.when(odd, F.concat(F.lit("sym"), (F.col("event_id") % 7).cast("string"))).alias("resolved_symbol"),
        F.when(odd, (F.col("event_id") % 100).cast("int")).alias("resolved_line"),
        F.col("ts").cast("timestamp").alias("observed_at"),
    )


MIDDLE = "2024-01-20 00:00:00"
ALIASES = f"""obs AS (
    SELECT event_type AS alias_term, 'user' || user_id AS resolved_path, CAST(ts AS TIMESTAMP) AS seen,
           CASE WHEN event_id % 2 = 1 THEN 'sym' || (event_id % 7) END AS symbol,
           CASE WHEN event_id % 2 = 1 THEN CAST(event_id % 100 AS INT) END AS line
    FROM events),
    aliases AS (
    SELECT alias_term, resolved_path, arg_max(symbol, seen) FILTER (WHERE symbol IS NOT NULL) AS resolved_symbol,
           arg_max(line, seen) FILTER (WHERE line IS NOT NULL) AS resolved_line, count(*) AS hit_count,
           CASE WHEN count(*) FILTER (WHERE seen < TIMESTAMP '{MIDDLE}') > 0
                THEN least(1.0, least(1.0, 0.8 + 0.05 * (count(*) FILTER (WHERE seen < TIMESTAMP '{MIDDLE}') - 1)) + 0.05 * count(*) FILTER (WHERE seen >= TIMESTAMP '{MIDDLE}'))
                ELSE least(1.0, 0.8 + 0.05 * (count(*) - 1)) END AS confidence,
           min(seen) AS created_at, max(seen) AS last_used_at
    FROM obs GROUP BY ALL)"""


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias table after two batches of observations."""
    from ..model import ALIASES as ddl
    from ..operators.aliases import upsert

    seen = observations(spark, sf_dir)
    none = spark.createDataFrame([], ddl)
    return upsert(upsert(none, seen.where(F.col("observed_at") < F.lit(MIDDLE).cast("timestamp"))), seen.where(F.col("observed_at") >= F.lit(MIDDLE).cast("timestamp")))


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias table with what earlier searches taught: the whole text of every third benchmark item stands for the item."""
    from ..operators.aliases import upsert

    items = table(spark, sf_dir, "benchmark").where("item_id % 3 = 0")
    none = F.lit(None)
    taught = items.select(F.col("text").alias("alias_term"), F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("resolved_path"), none.cast("string").alias("resolved_symbol"), none.cast("int").alias("resolved_line"), F.lit(AS_OF).cast("timestamp").alias("observed_at"))
    return upsert(aliases(spark, sf_dir), taught)


LEARNED = f"""{ALIASES}, learned AS (
    SELECT alias_term, resolved_path, confidence FROM aliases
    UNION ALL SELECT text, 'item/' || item_id, 0.8 FROM benchmark WHERE item_id % 3 = 0)"""


def documents_as_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as skills that their whole text describes."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat("lang", F.lit("-"), "source", F.lit("-"), F.col("doc_id").cast("string")).alias("name"),
        F.coalesce("text", F.lit("")).alias("description"),
        F.array("source").alias("triggers"),
        F.array("lang", "source").alias("keywords"),
    )


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as skills."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("relative_path"),
        F.lit("").alias("title"),
        F.col("p_name").alias("intent"),
        F.concat("p_type", F.lit(" "), "p_name").alias("description"),
        F.array("p_brand").alias("triggers"),
        F.array("p_type").alias("action_triggers"),
        F.split("p_name", " ").alias("micro_rules"),
        F.array("p_brand", "p_type").alias("keywords"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("content"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name that a part has."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("query_id"))


def _word_sql(weights: list[tuple[str, int]], word: str = "w") -> str:
    return " + ".join(f"CASE WHEN contains({field}, {word}) THEN {weight} ELSE 0 END" for field, weight in weights)


SKILLS = f"""skills AS (
    SELECT lower(replace(p_name, ' ', '-') || '-' || p_partkey) AS name, lower(p_brand || '/' || p_type) AS path, lower(p_name) AS intent, lower(p_type || ' ' || p_name) AS description,
           lower(p_brand) AS triggers, lower(p_type) AS actions, lower(p_name) AS rules, lower(p_brand || ' ' || p_type) AS keywords,
           lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size) AS content, replace(p_name, ' ', '-') || '-' || p_partkey AS shown
    FROM part),
    tasks AS (SELECT p_name AS text, min(p_partkey) AS query_id FROM part GROUP BY p_name),
    scored AS (
    SELECT query_id, text, skills.*,
           (CASE WHEN name = lower(text) THEN 100 WHEN contains(name, lower(text)) THEN 70 ELSE 0 END
            + CASE WHEN intent <> '' AND contains(intent, lower(text)) THEN 60 ELSE 0 END
            + CASE WHEN description <> '' AND contains(description, lower(text)) THEN 40 ELSE 0 END
            + CASE WHEN triggers <> '' AND contains(triggers, lower(text)) THEN 50 ELSE 0 END
            + CASE WHEN actions <> '' AND contains(actions, lower(text)) THEN 60 ELSE 0 END
            + coalesce(list_sum(list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), lambda w:
                {_word_sql([("name", 40), ("actions", 35), ("intent", 25), ("triggers", 25), ("rules", 20), ("description", 15), ("keywords", 20), ("content", 5)])})), 0)) / 100.0 AS score
    FROM skills, tasks),
    stage1 AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shown) AS rank FROM scored WHERE score > 0 OR trim(text) = ''
    QUALIFY rank <= 16)"""
