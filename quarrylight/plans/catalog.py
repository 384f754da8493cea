"""Every query of the library over the driver's tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aliases as A
from ..operators import chunks, documents, graph, learnings, merge, ranking, search, usage, vector_search
from ..session import table
from . import tables as R
from .registered import QUERIES, SQL, query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _as_of():
    return F.lit(R.AS_OF).cast("timestamp")


# Text and chunks ---------------------------------------------------------------------

_LINES = R.LINES


@query(f"SELECT doc_id, len({_LINES}) AS n_lines FROM documents")
def line_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.lines_of(F.col("text"))).cast("long").alias("n_lines"))


@query("SELECT doc_id, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) AS n_tokens, CAST(ceil(strlen(coalesce(text, '')) / 2.8) AS BIGINT) AS n_code_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"), T.token_estimate(F.col("text"), code=True).alias("n_code_tokens"))


_CHUNKS = f"""lines AS (SELECT doc_id, {_LINES} AS lines FROM documents),
    cuts AS (SELECT doc_id, lines, unnest(range(0, len(lines), 40)) AS p FROM lines WHERE len(lines) > 0),
    chunks AS (
        SELECT doc_id, p + 1 AS start_line, p + len(lines[p + 1:p + 50]) AS end_line,
               len(list_filter(lines[p + 1:p + 50], lambda x: {R.trim_sql('x')} <> '')) AS n_filled,
               array_to_string(lines[p + 1:p + 50], chr(10)) AS chunk_text
        FROM cuts WHERE n_filled >= 3)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, start_line, end_line, n_filled, substr(md5(chunk_text), 1, 16) AS content_hash FROM chunks")
def chunk_windows(spark, sf_dir):
    own = chunks.chunk_windows(_docs(spark, sf_dir))
    return own.select("doc_id", "start_line", "end_line", "n_filled", T.content_hash(F.col("chunk_text")).alias("content_hash"))


@query(
    rf"""WITH {_CHUNKS}, {R.TERMS},
    idx AS (SELECT DISTINCT doc_id, start_line, end_line, unnest(regexp_extract_all(lower(chunk_text), '[\p{{L}}\p{{N}}]+')) AS term FROM chunks),
    {R.match_sql("idx", "doc_id, start_line, end_line", "hits")}
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, start_line) AS rank FROM hits) WHERE rank <= 10"""
)
def chunk_fts(spark, sf_dir):
    keys = ["doc_id", "start_line", "end_line"]
    index = chunks.postings(chunks.chunk_windows(_docs(spark, sf_dir)), keys, F.col("chunk_text"))
    hits = chunks.match_all(index, R.queries(spark, sf_dir), keys)
    ranked = hits.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY doc_id, start_line)"))
    return ranked.where("rank <= 10")


def _fts(spark, sf_dir) -> DataFrame:
    return chunks.match_all(chunks.postings(_docs(spark, sf_dir), ["doc_id"], F.col("text")), R.queries(spark, sf_dir), ["doc_id"])


@query(f"WITH {R.INDEX}, {R.TERMS}, {R.match_sql('idx', 'doc_id', 'hits')} SELECT query_id, doc_id FROM hits")
def fts_batch(spark, sf_dir):
    return _fts(spark, sf_dir)


@query(
    r"""SELECT item_id, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'),
        lambda w: w <> '' AND lower(w) NOT IN ('and', 'or', 'not', 'near')), lambda w: '"' || w || '"'), ' ') AS query FROM benchmark"""
)
def sanitize_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.sanitize_query(F.col("text")).alias("query"))


@query(
    f"""WITH lines AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS line_no FROM documents)
    SELECT doc_id, line_no, substr({R.trim_sql('line')}, 1, 100) AS snippet FROM lines WHERE contains(lower(line), 'idiot') ORDER BY doc_id, line_no LIMIT 30"""
)
def line_references(spark, sf_dir):
    return chunks.line_references(_docs(spark, sf_dir), "idiot")


@query(
    rf"""WITH lines AS (SELECT doc_id, unnest({_LINES}) AS raw, generate_subscripts({_LINES}, 1) AS pos FROM documents),
    cut AS (SELECT doc_id, pos, regexp_replace(raw, '\s+$', '') AS line FROM lines),
    kept AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM cut)
    SELECT d.doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (line = '' AND coalesce(before, 'x') = '')), '')) AS content_hash
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""
)
def compress_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.compress(F.coalesce("text", F.lit(""))).cast("binary")).alias("content_hash"))


@query("SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS content_hash, strlen(html) - strlen(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS n_removed FROM pages")
def strip_comments(spark, sf_dir):
    bare = T.strip_markup_comments(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(bare.cast("binary")).alias("content_hash"), (T.bytes_of(F.col("html")) - T.bytes_of(bare)).alias("n_removed"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_without_label(spark, sf_dir):
    return vector_search.missing(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars")


@query("SELECT conv_id, turn, coalesce(len(list_filter(['ok', 'proceed', 'approved', 'approve', 'start', 'go ahead', 'do it', 'làm đi', 'đồng ý', 'chấp nhận', 'yes', 'yep', 'lgtm', 'looks good', 'agree', 'let''s do it', 'make the change', 'exec', 'triển khai', 'tiến hành', 'duyệt', 'thực thi', 'chốt', 'ok bro', 'được đấy'], lambda p: contains(lower(trim(text)), p))) > 0, false) AS approved FROM conversations")
def approvals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(T.is_approval(F.col("text")), F.lit(False)).alias("approved"))


# Vectors -----------------------------------------------------------------------------

_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


def _one(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).collect()[0]["embedding"])


_FIRST = "(SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a"


@query(f"SELECT b.vec_id AS id, round({_COS}, 6) AS score FROM {_FIRST}, embeddings b ORDER BY {_COS} DESC, id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return vector_search.top_k(R.vectors(spark, sf_dir), _one(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT b.vec_id AS id, round({_COS}, 6) AS score FROM {_FIRST}, embeddings b WHERE {_COS} >= 0.3 ORDER BY {_COS} DESC, id LIMIT 50")
def cosine_threshold(spark, sf_dir):
    return vector_search.top_k(R.vectors(spark, sf_dir), _one(spark, sf_dir), 50, threshold=0.3).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT b.vec_id AS id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM {_FIRST}, embeddings b ORDER BY list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, id LIMIT 10")
def dot_topk(spark, sf_dir):
    return vector_search.top_k(R.vectors(spark, sf_dir), _one(spark, sf_dir), 10, measure="dot").select("id", F.round("score", 6).alias("score"))


def _near(spark, sf_dir, k: int, threshold: float) -> DataFrame:
    """The vector of each benchmark item's number asks."""
    own = R.vectors(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    asked = own.join(items, "id").select(F.col("id").alias("query_id"), "vector")
    return vector_search.batch_top_k(own, asked, k, threshold=threshold)


_NEAR = f"""near AS (
    SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a JOIN benchmark q ON a.vec_id = q.item_id, embeddings b WHERE a.vec_id <> b.vec_id)"""


@query(f"WITH {_NEAR} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 5")
def cosine_all_queries(spark, sf_dir):
    return _near(spark, sf_dir, 5, -1.0).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


# Usage -------------------------------------------------------------------------------


@query(f"WITH {R.EVENTS} SELECT tool_name, operation, count(*) AS calls, coalesce(sum(tokens_original), 0) AS tokens_original, coalesce(sum(tokens_optimized), 0) AS tokens_optimized, count(error_message) AS errors FROM calls GROUP BY ALL ORDER BY calls DESC, tool_name, operation NULLS FIRST LIMIT 50")
def tool_breakdown(spark, sf_dir):
    return usage.tool_breakdown(R.events(spark, sf_dir))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id LIMIT 50")
def top_tools(spark, sf_dir):
    return usage.top_tools(R.events(spark, sf_dir), "user_id")


@query(f"WITH {R.EVENTS} SELECT event_id, tool_name, operation, tokens_original FROM calls ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf_dir):
    return usage.recent(R.events(spark, sf_dir), 50).select("event_id", "tool_name", "operation", "tokens_original")


_DAILY = "daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS calls, sum(tokens_original) AS tokens_original, sum(tokens_optimized) AS tokens_optimized FROM calls GROUP BY ALL)"


@query(f"WITH {R.EVENTS}, {_DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, calls, tokens_original, tokens_optimized FROM daily")
def daily_summary(spark, sf_dir):
    return usage.daily_summary(R.events(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    f"""WITH {R.EVENTS}, spine AS (
        SELECT DISTINCT c.user_id, h.hour FROM calls c, (SELECT unnest(generate_series(date_trunc('hour', TIMESTAMP '{R.AS_OF}') - INTERVAL 23 HOUR, date_trunc('hour', TIMESTAMP '{R.AS_OF}'), INTERVAL 1 HOUR)) AS hour) h),
    sums AS (SELECT user_id, date_trunc('hour', ts) AS hour, sum(tokens_original) AS o, sum(tokens_optimized) AS p FROM calls GROUP BY ALL)
    SELECT s.user_id, strftime(s.hour, '%H:00') AS label, coalesce(o, 0) AS tokens_original, coalesce(p, 0) AS tokens_optimized
    FROM spine s LEFT JOIN sums u ON s.user_id = u.user_id AND s.hour = u.hour"""
)
def hourly_spine(spark, sf_dir):
    return usage.hourly_spine(R.events(spark, sf_dir), _as_of(), key="user_id").drop("hour")


@query(
    f"""WITH {R.EVENTS} SELECT count(*) AS calls, sum(tokens_original) AS tokens_original, sum(tokens_optimized) AS tokens_optimized,
        sum(tokens_original) - sum(tokens_optimized) AS saved,
        CASE WHEN sum(tokens_original) > 0 THEN round(100.0 * (sum(tokens_original) - sum(tokens_optimized)) / sum(tokens_original), 1) ELSE 0 END AS saved_percent
    FROM calls WHERE ts >= TIMESTAMP '{R.AS_OF}' - INTERVAL 24 HOUR"""
)
def trailing_windows(spark, sf_dir):
    return usage.trailing_day(R.events(spark, sf_dir), _as_of())


def _rollup_sql() -> str:
    spans = (("week", "INTERVAL 7 DAY"), ("month", "INTERVAL 30 DAY"), ("life", None))
    parts = [f"coalesce(sum({c}) {f'FILTER (day >= CAST(TIMESTAMP ' + repr(R.AS_OF) + ' AS DATE) - ' + span + ')' if span else ''}, 0) AS {name}_{c}" for name, span in spans for c in ("calls", "tokens_original", "tokens_optimized")]
    return f"WITH {R.EVENTS}, {_DAILY} SELECT {', '.join(parts)} FROM daily"


@query(_rollup_sql())
def rollup_windows(spark, sf_dir):
    return usage.rollups(usage.daily_summary(R.events(spark, sf_dir)), F.to_date(_as_of()))


@query(f"WITH {R.EVENTS}, {_DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN tokens_original > 0 THEN round(100.0 * (tokens_original - tokens_optimized) / tokens_original, 1) ELSE 0 END AS saved_percent FROM daily")
def savings_pct(spark, sf_dir):
    own = usage.daily_summary(R.events(spark, sf_dir))
    return own.select(F.date_format("day", "yyyy-MM-dd").alias("day"), T.saved_percent(F.col("tokens_original"), F.col("tokens_optimized")).alias("saved_percent"))


@query(f"WITH {R.EVENTS} SELECT user_id, count(*) AS calls, sum(tokens_original) AS tokens_original, sum(tokens_optimized) AS tokens_optimized FROM calls GROUP BY ALL")
def session_counters(spark, sf_dir):
    return usage.session_counters(R.events(spark, sf_dir), "user_id")


@query(
    f"""WITH {R.EVENTS}, gaps AS (SELECT event_id, user_id, CAST(floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000) AS BIGINT) AS gap_seconds FROM calls)
    SELECT * FROM gaps WHERE gap_seconds > 300"""
)
def stale_sessions(spark, sf_dir):
    return usage.stale_sessions(R.events(spark, sf_dir), "user_id").select("event_id", "user_id", "gap_seconds")


@query(f"WITH {R.EVENTS} SELECT event_id, tool_name FROM calls WHERE ts >= TIMESTAMP '{R.AS_OF}' - INTERVAL 24 HOUR AND tool_name <> 'view'")
def retention_prune(spark, sf_dir):
    return usage.retain(R.events(spark, sf_dir), _as_of(), "view").select("event_id", "tool_name")


# Graph -------------------------------------------------------------------------------

_FAN = "fan AS (SELECT target, count(DISTINCT source) AS n_dependents FROM edges WHERE source <> target GROUP BY target)"


@query(f"WITH {R.EDGES}, {_FAN} SELECT * FROM fan")
def edge_fanin(spark, sf_dir):
    return graph.fan_in(R.edges(spark, sf_dir, distinct=False))


@query(f"WITH {R.EDGES} SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source) AS rank FROM edges WHERE source <> target QUALIFY rank <= 10")
def dependents(spark, sf_dir):
    return graph.dependents(R.edges(spark, sf_dir, distinct=False))


@query(f"WITH {R.EDGES}, {_FAN} SELECT *, CASE WHEN n_dependents > 8 THEN 'High' WHEN n_dependents >= 3 THEN 'Medium' ELSE 'Low' END AS level FROM fan")
def risk_levels(spark, sf_dir):
    return graph.risk(R.edges(spark, sf_dir, distinct=False))


@query(
    f"""WITH {R.EDGES}, {R.SYMBOLS} SELECT a.name AS source_name, b.name AS target_name, 'ships' AS edge_type
    FROM edges e JOIN symbols a ON e.source = a.id JOIN symbols b ON e.target = b.id
    WHERE contains(lower(a.name), '1') OR contains(lower(b.name), '1') ORDER BY 1, 2, 3 LIMIT 20"""
)
def related_edges(spark, sf_dir):
    return graph.related(_links(spark, sf_dir), R.symbols(spark, sf_dir), "1")


def _links(spark, sf_dir) -> DataFrame:
    return R.edges(spark, sf_dir).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("ships").alias("edge_type"))


@query(f"WITH {R.EDGES}, {R.SYMBOLS} SELECT DISTINCT b.file_path AS file, a.file_path AS dependent FROM edges e JOIN symbols a ON e.source = a.id JOIN symbols b ON e.target = b.id WHERE a.file_path <> b.file_path")
def incoming_files(spark, sf_dir):
    return graph.incoming(_links(spark, sf_dir), R.symbols(spark, sf_dir))


# Aliases -----------------------------------------------------------------------------


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("alias_term", "resolved_path", "resolved_symbol", "resolved_line", "hit_count", F.round("confidence", 6).alias("confidence"))


_SHOWN = "alias_term, resolved_path, resolved_symbol, resolved_line, hit_count, round({0}, 6) AS confidence"


@query(f"WITH {R.ALIASES} SELECT {_SHOWN.format('confidence')} FROM aliases")
def alias_upsert(spark, sf_dir):
    return _shown(R.aliases(spark, sf_dir))


@query(f"WITH {R.ALIASES} SELECT {_SHOWN.format('confidence')} FROM aliases WHERE contains(alias_term, 'chase') OR contains('chase', alias_term) ORDER BY confidence DESC, hit_count DESC, last_used_at DESC, alias_term, resolved_path LIMIT 10")
def alias_lookup(spark, sf_dir):
    own = R.aliases(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))
    return _shown(A.lookup(own, "CHASE"))


@query(
    f"""WITH {R.ALIASES} SELECT {_SHOWN.format("CASE WHEN TIMESTAMP '2024-02-28 06:00:00' - last_used_at > INTERVAL 30 DAY AND confidence > 0.1 THEN greatest(0.1, confidence * 0.5) ELSE confidence END")}
    FROM aliases WHERE TIMESTAMP '2024-02-28 06:00:00' - last_used_at <= INTERVAL 90 DAY"""
)
def alias_decay(spark, sf_dir):
    return _shown(A.decay(R.aliases(spark, sf_dir), F.lit("2024-02-28 06:00:00")))


# Windows, merges ---------------------------------------------------------------------


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1 ORDER BY n_chars DESC, doc_id LIMIT 8")
def first_per_name(spark, sf_dir):
    return merge.first_per_name(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "source", "n_chars", "doc_id", 8)


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 3")
def keep_newest_n(spark, sf_dir):
    return merge.keep_newest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", 3, "role")


@query("SELECT conv_id, turn, role, round(row_number() OVER (PARTITION BY conv_id ORDER BY turn) / count(*) OVER (PARTITION BY conv_id), 6) AS recency FROM conversations")
def recency_weight(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("ord"), "role")
    return ranking.recency(own).select(F.col("owner").alias("conv_id"), F.col("ord").alias("turn"), "role", F.round("recency", 6).alias("recency"))


@query("SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS header FROM conversations")
def carry_forward(spark, sf_dir):
    header = F.expr("last(CASE WHEN role = 'user' THEN text END, true) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(header.cast("binary")).alias("header"))


@query(
    """WITH turns AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS a, string_split(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), chr(10)) AS b FROM conversations)
    SELECT conv_id, turn, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS added, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS removed FROM turns"""
)
def line_delta(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").selectExpr("struct(conv_id, turn) AS at", "lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before", "text AS after")
    return merge.line_delta(own, "at", "before", "after").select("at.conv_id", "at.turn", "added", "removed")


def _stored(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), F.lit(1).alias("version"))


def _current(spark, sf_dir) -> DataFrame:
    """Labelled documents, toxic ones redacted, and pages."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    text = F.when(F.col("toxic") == 1, "").otherwise(F.coalesce("text", F.lit("")))
    docs = _docs(spark, sf_dir).join(labels, "doc_id").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), T.content_hash(text).alias("content_hash"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), T.content_hash(F.coalesce("html", F.lit(""))).alias("content_hash"))
    return docs.unionByName(pages).withColumn("version", F.lit(2))


_SNAPSHOTS = """stored AS (SELECT 'doc/' || doc_id AS path, substr(md5(coalesce(text, '')), 1, 16) AS content_hash FROM documents),
    current AS (
        SELECT 'doc/' || d.doc_id AS path, substr(md5(CASE WHEN toxic = 1 THEN '' ELSE coalesce(text, '') END), 1, 16) AS content_hash FROM documents d JOIN labels l ON d.doc_id = l.doc_id
        UNION ALL SELECT 'page/' || page_id, substr(md5(coalesce(html, '')), 1, 16) FROM pages)"""


@query(
    f"""WITH {_SNAPSHOTS} SELECT coalesce(s.path, c.path) AS path,
        CASE WHEN s.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN s.content_hash = c.content_hash THEN 'same' ELSE 'changed' END AS status
    FROM stored s FULL JOIN current c ON s.path = c.path"""
)
def incremental_diff(spark, sf_dir):
    return merge.diff(_stored(spark, sf_dir), _current(spark, sf_dir))


@query(f"WITH {_SNAPSHOTS} SELECT coalesce(c.path, s.path) AS path, coalesce(c.content_hash, s.content_hash) AS content_hash, CASE WHEN c.path IS NULL THEN 1 ELSE 2 END AS version FROM stored s FULL JOIN current c ON s.path = c.path")
def merge_latest(spark, sf_dir):
    return merge.merge_latest(_stored(spark, sf_dir), _current(spark, sf_dir), ["path"], "version").select("path", "content_hash", "version")


@query(SQL["merge_latest"])
def file_upsert(spark, sf_dir):
    return merge.upsert_files(_stored(spark, sf_dir), _current(spark, sf_dir))


# Ranking -----------------------------------------------------------------------------


def _stage1(spark, sf_dir) -> DataFrame:
    return ranking.stage_one(R.skills(spark, sf_dir), R.tasks(spark, sf_dir), 16)


@query(f"WITH {R.SKILLS} SELECT query_id, shown AS name, rank, round(score, 6) AS score FROM stage1")
def lexical_stage1(spark, sf_dir):
    return _stage1(spark, sf_dir).select("query_id", "name", "rank", F.round("score", 6).alias("score"))


@query(
    rf"""WITH {R.SKILLS} SELECT query_id, shown AS name, round(score
        + coalesce(list_sum(list_transform(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''), lambda w:
            CASE WHEN name = w THEN 30 WHEN contains(name, w) THEN 15 ELSE 0 END + CASE WHEN contains(actions, w) THEN 20 ELSE 0 END
            + CASE WHEN contains(intent, w) THEN 15 ELSE 0 END + CASE WHEN contains(triggers, w) THEN 15 ELSE 0 END
            + CASE WHEN contains(rules, w) THEN 10 ELSE 0 END + CASE WHEN contains(description, w) THEN 10 ELSE 0 END
            + CASE WHEN contains(keywords, w) THEN 10 ELSE 0 END + CASE WHEN contains(content, w) THEN 3 ELSE 0 END)), 0) / 100.0, 6) AS final FROM stage1"""
)
def lexical_stage2(spark, sf_dir):
    return ranking.stage_two(_stage1(spark, sf_dir)).select("query_id", "name", F.round("final", 6).alias("final"))


def _affinity_sql() -> str:
    universal = " OR ".join(f"contains(name, '{w}') OR contains(path, '{w}')" for w in ranking.UNIVERSAL)
    bound = ", ".join(f"CASE WHEN contains(name, '{w}') OR contains(path, '{w}') THEN '{v}' END" for w, v in ranking.LANGUAGE_WORDS)
    domains = ", ".join(f"CASE WHEN contains(name, '{w}') OR contains(path, '{w}') THEN '{w}' END" for w in ranking.DOMAIN_WORDS)
    return f"""WITH skills AS (SELECT page_id, lower(url) AS name, lower(regexp_replace(url, '^https?://', '')) AS path FROM pages)
        SELECT page_id, ({universal}) OR (
            (len(list_filter([{bound}], lambda x: x IS NOT NULL)) = 0 OR list_has_any(list_filter([{bound}], lambda x: x IS NOT NULL), ['rust', 'go']))
            AND len(list_filter([{domains}], lambda x: x IS NOT NULL AND x NOT IN ('sql', 'database'))) = 0) AS suits FROM skills"""


@query(_affinity_sql())
def affinity_filter(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"), F.regexp_replace("url", "^https?://", "").alias("relative_path"))
    suits = ranking.affinity(F.lit("tidy the parser"), F.array(F.lit("rust"), F.lit("go")), F.array(F.lit("sql"), F.lit("database")))
    return own.select("page_id", suits.alias("suits"))


def _paths(rows: DataFrame, path) -> DataFrame:
    return rows.select("query_id", path.alias("path"), F.lit(0.0).alias("score"))


def _vector_paths(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.concat(F.lit("vec/"), F.col("id").cast("string")).alias("path"), F.round("score", 6).alias("score"))


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _phases(spark, sf_dir) -> dict[str, DataFrame]:
    """What each phase finds for the whole benchmark texts: aliases, lines as symbols, documents as content, vectors."""
    close = A.lookup_batch(R.learned(spark, sf_dir).withColumn("confidence", F.round("confidence", 6)), _asked(spark, sf_dir))
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("line_no", "line"))
    symbols = chunks.match_all(chunks.postings(lines, ["doc_id", "line_no"], F.col("line")), R.queries(spark, sf_dir), ["doc_id", "line_no"])
    doc = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return {
        "aliases": close.select("query_id", F.col("resolved_path").alias("path"), F.col("confidence").alias("score")),
        "symbols": _paths(symbols, F.concat(doc, F.lit("#"), (F.col("line_no") + 1).cast("string"))),
        "content": _paths(_fts(spark, sf_dir), doc),
        "vectors": _vector_paths(_near(spark, sf_dir, 50, 0.2)),
    }


_PHASES = rf"""{R.INDEX}, {R.TERMS}, {R.LEARNED}, {R.match_sql("idx", "doc_id", "content")},
    rows AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS line_no FROM documents),
    lidx AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+')) AS term FROM rows),
    {R.match_sql("lidx", "doc_id, line_no", "symbols")}, {_NEAR},
    phases AS (
        SELECT item_id AS query_id, 1 AS phase, 10 AS cap, resolved_path AS path, max(round(confidence, 6)) AS score FROM benchmark JOIN learned
            ON contains(lower(alias_term), lower(text)) OR contains(lower(text), lower(alias_term)) GROUP BY ALL
        UNION ALL SELECT query_id, 2, 15, 'doc/' || doc_id || '#' || line_no, 0.0 FROM symbols
        UNION ALL SELECT query_id, 3, 10, 'vec/' || id, round(score, 6) FROM near WHERE score >= 0.4
        UNION ALL SELECT query_id, 4, 10, 'doc/' || doc_id, 0.0 FROM content
        UNION ALL SELECT query_id, 5, 10, 'vec/' || id, round(score, 6) FROM near WHERE score >= 0.2)"""


@query(
    f"""WITH {_PHASES} SELECT query_id, phase, row_number() OVER (PARTITION BY query_id, phase ORDER BY score DESC, path) AS rank, path, score FROM phases p
    WHERE phase = (SELECT min(phase) FROM phases q WHERE q.query_id = p.query_id) QUALIFY rank <= cap"""
)
def cascade_batch(spark, sf_dir):
    own = _phases(spark, sf_dir)
    return search.cascade([(own["aliases"], 10), (own["symbols"], 15), (own["vectors"].where("score >= 0.4"), 10), (own["content"], 10), (own["vectors"], 10)])


@query(
    f"""WITH {_PHASES}, {R.EDGES}, ends AS (
        SELECT item_id AS query_id, 'edges' AS section, target AS path, 0.0 AS score FROM benchmark JOIN edges ON edges.source = 's' || item_id),
    every AS (SELECT query_id, CASE phase WHEN 1 THEN 'aliases' WHEN 2 THEN 'symbols' ELSE 'content' END AS section, path, score FROM phases WHERE phase IN (1, 2, 4) UNION ALL SELECT * FROM ends)
    SELECT query_id, section, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, path) AS rank, path, score FROM every QUALIFY rank <= 5"""
)
def navigate_batch(spark, sf_dir):
    own = _phases(spark, sf_dir)
    asked = _asked(spark, sf_dir).select("query_id", F.concat(F.lit("s"), F.col("query_id").cast("string")).alias("source"))
    ends = R.edges(spark, sf_dir).join(asked, "source").select("query_id", F.col("target").alias("path"), F.lit(0.0).alias("score"))
    return search.navigate({"aliases": own["aliases"], "symbols": own["symbols"], "content": own["content"], "edges": ends})


# Documents ---------------------------------------------------------------------------

_SECTIONS = f"""rows AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS line_no FROM documents),
    marked AS (SELECT *, line_no % 10 = 0 AS h, sum(CAST(line_no % 10 = 0 AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM rows),
    sections AS (
        SELECT doc_id, section, coalesce(max(line) FILTER (h), 'Overview') AS title, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT h) AS body, count(*) FILTER (NOT h) AS n_lines
        FROM marked GROUP BY ALL HAVING count(*) FILTER (NOT h) > 0)"""


def _sections(spark, sf_dir) -> DataFrame:
    return documents.section_split(_docs(spark, sf_dir), lambda _, no: no % 10 == 0, lambda line: line)


@query(f"WITH {_SECTIONS} SELECT doc_id, section, md5(title) AS title, md5(body) AS body, n_lines FROM sections")
def section_split(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "section", F.md5(F.col("title").cast("binary")).alias("title"), F.md5(F.col("body").cast("binary")).alias("body"), "n_lines")


@query(
    f"""WITH {_SECTIONS}, hits AS (SELECT *, contains(lower(title || chr(10) || body), 'idiot') AS hit, count(*) OVER (PARTITION BY doc_id) AS n FROM sections),
    placed AS (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY doc_id) AS hits, sum(CAST(hit AS INT)) OVER (PARTITION BY doc_id ORDER BY section) AS place FROM hits)
    SELECT doc_id, section, md5(body) AS body FROM placed WHERE n <= 3 OR hits = 0 OR (hit AND place <= 3)"""
)
def section_slice(spark, sf_dir):
    return documents.section_slice(_sections(spark, sf_dir), "idiot", 3).select("doc_id", "section", F.md5(F.col("body").cast("binary")).alias("body"))


@query(
    """WITH x AS (SELECT lower(url) AS path FROM pages), e AS (
        SELECT string_split(path, '.')[-1] AS ext FROM x UNION SELECT 'docker' FROM x WHERE path LIKE '%docker%')
    SELECT array_to_string(list_sort(list_distinct(['rust'] || coalesce(list(DISTINCT p) FILTER (p IS NOT NULL), []))), ',') AS primary_languages,
           array_to_string(list_sort(list_distinct(['rust'] || coalesce(list(DISTINCT s) FILTER (s IS NOT NULL), []))), ',') AS secondary_tech
    FROM (SELECT unnest(CASE WHEN ext IN ('js', 'jsx', 'ts', 'tsx', 'mjs', 'cjs') THEN ['javascript', 'typescript'] WHEN ext IN ('py', 'pyw') THEN ['python'] WHEN ext = 'php' THEN ['php'] ELSE [NULL] END) AS p, NULL AS s FROM e
          UNION ALL SELECT NULL, unnest(CASE WHEN ext IN ('html', 'css', 'scss', 'vue', 'svelte') THEN ['web', 'frontend'] WHEN ext IN ('docker', 'dockerfile') THEN ['docker', 'devops'] ELSE [NULL] END) FROM e)"""
)
def profile(spark, sf_dir):
    own = documents.language_profile(table(spark, sf_dir, "pages").select(F.col("url").alias("path")), "port it to rust")
    return own.select(F.array_join("primary_languages", ",").alias("primary_languages"), F.array_join("secondary_tech", ",").alias("secondary_tech"))


def _architecture_sql() -> str:
    rules = " ".join(f"WHEN max(CASE WHEN {' OR '.join(f'''contains(lower(url), '{w}')''' for w in words)} THEN 1 ELSE 0 END) = 1 THEN '{name}'" for name, words in documents.ARCHITECTURES)
    return f"SELECT CASE {rules} WHEN count(*) <= {documents.FLAT_MOST} THEN '{documents.FLAT}' ELSE '{documents.DEFAULT}' END AS pattern FROM pages"


@query(_architecture_sql())
def architecture(spark, sf_dir):
    return documents.architecture(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


# Streaming twins ---------------------------------------------------------------------


def _stream(spark, sf_dir, width: str) -> DataFrame:
    from ..streaming import usage as S

    schema = table(spark, sf_dir, "events").schema
    own = S.read_events(spark, sf_dir, schema, pattern="events.parquet").withColumn("tokens", F.floor(F.col("value") * 100).cast("long"))
    done = S.drain(S.windowed(own, width, keys=("event_type",)), ["start", "event_type"])
    return done.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "calls", "tokens")


def _stream_sql(unit: str) -> str:
    return f"SELECT strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS calls, sum(CAST(floor(value * 100) AS BIGINT)) AS tokens FROM events GROUP BY ALL"


@query(_stream_sql("hour"))
def stream_hourly(spark, sf_dir):
    return _stream(spark, sf_dir, "1 hour")


@query(_stream_sql("day"))
def stream_daily(spark, sf_dir):
    return _stream(spark, sf_dir, "1 day")


# More scalar functions and lookups ------------------------------------------------------


@query(
    f"""WITH {R.EVENTS}, x AS (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '{R.AS_OF}') - epoch_us(ts)) / 1000000) AS BIGINT) AS age, tokens_original AS o, tokens_optimized AS p FROM calls)
    SELECT event_id, CASE WHEN age < 60 THEN age || 's ago' WHEN age < 3600 THEN (age // 60) || 'm ago' WHEN age < 86400 THEN (age // 3600) || 'h ago' ELSE (age // 86400) || 'd ago' END AS age,
           CASE WHEN o >= 1000 THEN printf('%.1fk', ((o + 50) // 100) / 10.0) ELSE CAST(o AS VARCHAR) END AS tokens,
           CASE WHEN o >= 1000 THEN printf('%.1fs', ((o + 50) // 100) / 10.0) ELSE o || 'ms' END AS duration,
           CASE WHEN q > 50 THEN 'green' WHEN q > 20 THEN 'plain' ELSE 'red' END AS badge
    FROM (SELECT *, CASE WHEN o > 0 THEN round(100.0 * (o - p) / o, 1) ELSE 0 END AS q FROM x WHERE age >= 0)"""
)
def shown_texts(spark, sf_dir):
    own = R.events(spark, sf_dir).withColumn("age", F.floor((F.unix_micros(_as_of()) - F.unix_micros("ts")) / 1000000)).where("age >= 0")
    saved = T.saved_percent(F.col("tokens_original"), F.col("tokens_optimized"))
    return own.select("event_id", T.age_text(F.col("age")).alias("age"), T.token_text(F.col("tokens_original")).alias("tokens"), T.duration_text(F.col("tokens_original")).alias("duration"), T.savings_badge(saved).alias("badge"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[ _]', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g') AS slug FROM pages")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("SELECT string_split(lower(url), '.')[-1] AS ext, count(*) AS n FROM pages GROUP BY ALL")
def extension_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.extension(F.col("url")).alias("ext")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'please') OR contains(lower(role), 'please')")
def filter_fields(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(T.matches_filter("please", "text", "role")).select("conv_id", "turn")


_PHASE = "CASE item_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'debug' WHEN 2 THEN 'plan' ELSE 'implement' END"


@query(
    f"""SELECT item_id, md5(CASE WHEN {_PHASE} = 'test' AND NOT contains(lower(text), 'test') THEN text || ' test testing unit mock'
        WHEN {_PHASE} = 'debug' AND NOT contains(lower(text), 'debug') THEN text || ' debug error recovery exception'
        WHEN {_PHASE} = 'plan' AND NOT contains(lower(text), 'plan') THEN text || ' architecture standards modular design' ELSE text END) AS query FROM benchmark"""
)
def expand_queries(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select("item_id", "text", F.expr(_PHASE).alias("phase"))
    return own.select("item_id", F.md5(T.expand_query(F.col("text"), F.lit(None).cast("string"), F.col("phase")).cast("binary")).alias("query"))


def _category_sql() -> str:
    rules = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in words)} THEN '{name}'" for name, words in learnings.CATEGORIES)
    return f"SELECT conv_id, turn, CASE {rules} END AS category FROM conversations"


@query(_category_sql())
def task_categories(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", learnings.task_category(F.col("text")).alias("category"))


@query(
    f"""WITH own AS (SELECT b.vec_id AS ord, row_number() OVER (PARTITION BY b.label ORDER BY b.vec_id) / count(*) OVER (PARTITION BY b.label) AS recency, {_COS} AS similarity FROM {_FIRST}, embeddings b)
    SELECT ord, round(0.8 * similarity + 0.2 * recency, 6) AS score FROM own WHERE similarity >= 0.1 ORDER BY 0.8 * similarity + 0.2 * recency DESC, ord DESC LIMIT 20"""
)
def learnings_rank(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("label").alias("owner"), F.col("embedding").alias("vector"))
    query = F.array(*(F.lit(float(x)) for x in _one(spark, sf_dir)))
    return ranking.rank_learnings(own, query, 20, 0.1).select("ord", F.round("score", 6).alias("score"))


def _metadata_sql() -> str:
    text = "lower(lang || '-' || source || '-' || doc_id) || ' ' || lower(coalesce(text, '')) || ' ' || lower(source)"

    def lists(rules, column):
        return " || ".join(f"CASE WHEN {' OR '.join(f'contains({column}, {w!r})' for w in words)} THEN [{', '.join(map(repr, gives))}] ELSE [] END" for words, gives in rules)

    phases = lists(documents.PHASES, "c")
    words = f"list_transform(list_filter(string_split_regex(regexp_replace(own, '[-_]', ' ', 'g'), '\\s+'), lambda w: strlen(w) >= 3 AND w NOT IN ({', '.join(map(repr, documents.EMPTY_WORDS))})), lambda w: lower(w))"
    actions = f"list_distinct({lists([((w,), (a, w)) for w, a in documents.ACTIONS], 'c')} || {words})"
    return f"""WITH x AS (SELECT doc_id, lang, source, lang || '-' || source || '-' || doc_id AS own, {text} AS c, lower(lang || '-' || source || '-' || doc_id) AS name FROM documents)
        SELECT doc_id, array_to_string(list_sort({actions}), ',') AS action_triggers, array_to_string(list_sort(list_distinct([lang, source] || {actions})), ',') AS keywords, array_to_string(list_sort(list_distinct({lists(documents.PATTERNS, "c")} || {lists(documents.NAME_PATTERNS, "name")})), ',') AS file_patterns,
               array_to_string(list_sort(list_distinct(CASE WHEN len({phases}) = 0 THEN ['implement', 'refactor'] ELSE {phases} END)), ',') AS applicable_phases FROM x"""


@query(_metadata_sql())
def metadata_inference(spark, sf_dir):
    found = documents.metadata(R.documents_as_skills(spark, sf_dir))
    return found.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("action_triggers", "keywords", "file_patterns", "applicable_phases")))


@query(
    rf"""WITH {R.INDEX}, {R.TERMS}, {R.match_sql("idx", "doc_id", "hits")}, asked AS (SELECT query_id, list(term) AS terms FROM terms GROUP BY query_id),
    x AS (SELECT h.query_id, h.doc_id, regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}]+') AS toks, a.terms FROM hits h JOIN documents d ON h.doc_id = d.doc_id JOIN asked a ON h.query_id = a.query_id),
    y AS (SELECT *, list_position(list_transform(toks, lambda t: list_contains(terms, t)), true) AS p FROM x)
    SELECT query_id, doc_id, array_to_string(toks[greatest(p - 7, 1):p - 1] || ['»' || toks[p] || '«'] || toks[p + 1:p + 7], ' ') AS snippet FROM y"""
)
def fts_snippets(spark, sf_dir):
    asked = _asked(spark, sf_dir).select("query_id", F.array_distinct(T.tokens_of(F.col("text"))).alias("terms"))
    hits = _fts(spark, sf_dir).join(asked, "query_id").join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return hits.select("query_id", "doc_id", chunks.snippet(F.col("text"), F.col("terms")).alias("snippet"))


@query("SELECT vec_id AS id, 4 * len(embedding) AS n_bytes, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last FROM embeddings")
def vector_codec(spark, sf_dir):
    from ..sources.files import bytes_vector, vector_bytes

    own = R.vectors(spark, sf_dir).withColumn("raw", vector_bytes(F.col("vector"))).withColumn("back", bytes_vector(F.col("raw")))
    total = F.round(F.aggregate("back", F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    end = lambda at: F.element_at("back", at).cast("double")
    return own.select("id", F.octet_length("raw").alias("n_bytes"), F.size("back").alias("n"), total.alias("total"), end(1).alias("first"), end(-1).alias("last"))


FLAGSHIP = "cascade_batch"

from . import dashboards, more, stored  # noqa: E402, F401  register the rest
