"""More queries over the driver's tables: symbols, aliases, ranking, notes, paths, listings, and an inline code base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import SPACES
from ..operators import aliases as A
from ..operators import chunks, code, documents, learnings, merge, ranking, usage
from ..session import table
from ..sources import files as S
from ..sources.providers import overlap_logit
from . import catalog as C
from . import tables as R
from .registered import query

_WORDS = r"[\p{L}\p{N}]+"


# Symbols and aliases -----------------------------------------------------------------


@query(
    rf"""WITH {R.SYMBOLS}, terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS term FROM (SELECT p_name AS text, min(p_partkey) AS query_id FROM part GROUP BY p_name)),
    sidx AS (SELECT DISTINCT id, file_path, unnest(regexp_extract_all(lower(name), '{_WORDS}')) AS term FROM symbols), {R.match_sql("sidx", "id, file_path", "hits")}
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM hits) WHERE rank <= 10"""
)
def symbol_fts(spark, sf_dir):
    keys = ["id", "file_path"]
    hits = chunks.match_all(chunks.postings(R.symbols(spark, sf_dir), keys, F.col("name")), chunks.query_terms(R.tasks(spark, sf_dir), F.col("text")), keys)
    return hits.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY id)")).where("rank <= 10")


@query(
    f"""WITH {C._NEAR}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 3)
    SELECT query_id, doc_id, rank, n_chars, lang FROM best JOIN documents ON id = doc_id"""
)
def near_contents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return C._near(spark, sf_dir, 3, -1.0).join(docs, F.col("id") == F.col("doc_id")).select("query_id", "doc_id", "rank", "n_chars", "lang")


@query(f"WITH {R.ALIASES} SELECT alias_term, resolved_path, 2 * hit_count AS hit_count, round(confidence, 6) AS confidence, strftime(last_used_at, '%Y-%m-%d %H:%M:%S') AS last_used FROM aliases")
def alias_bump(spark, sf_dir):
    used = R.observations(spark, sf_dir).select("alias_term", "resolved_path", F.col("observed_at").alias("used_at"))
    own = A.bump(R.aliases(spark, sf_dir), used)
    return own.select("alias_term", "resolved_path", "hit_count", F.round("confidence", 6).alias("confidence"), F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


@query(
    f"""WITH {C._PHASES}, first AS (SELECT query_id, phase, path, row_number() OVER (PARTITION BY query_id ORDER BY phase, score DESC, path) AS n FROM phases)
    SELECT md5(text) AS term, path AS resolved_path FROM first JOIN benchmark ON item_id = query_id WHERE n = 1 AND phase <> 1"""
)
def alias_learn(spark, sf_dir):
    taught = A.learn(C.cascade_batch(spark, sf_dir), C._asked(spark, sf_dir), F.lit(R.AS_OF).cast("timestamp"))
    return taught.select(F.md5(F.col("alias_term").cast("binary")).alias("term"), "resolved_path")


# Counts, tables, scales --------------------------------------------------------------

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, sf_dir):
    own: DataFrame | None = None
    for name in _TABLES:
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        own = one if own is None else own.unionByName(one)
    return own


@query(f"WITH {R.EVENTS} SELECT greatest(0, max(coalesce(tokens_original, 0)), max(coalesce(tokens_optimized, 0))) AS top FROM calls")
def field_maximum(spark, sf_dir):
    return R.events(spark, sf_dir).agg(T.field_maximum("tokens_original", "tokens_optimized").alias("top"))


@query(f"WITH {R.EVENTS} SELECT event_id, tool_name, tokens_original, row_number() OVER (ORDER BY tokens_original DESC NULLS LAST, event_id) AS place FROM calls")
def sorted_table(spark, sf_dir):
    own = R.events(spark, sf_dir).select("event_id", "tool_name", "tokens_original")
    return usage.sorted_rows(own, "tokens_original", "event_id", descending=True)


@query(
    f"""WITH {R.EVENTS}, {C._DAILY}, x AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n, max(tokens_original) OVER () AS top FROM daily)
    SELECT strftime(day, '%Y-%m-%d') AS day, round(186 - CASE WHEN top <> 0 THEN tokens_original / top * 170 ELSE 0 END, 6) AS y,
           round(38 + 724.0 / n * i + 724.0 / n / 2, 6) AS x, round(greatest(4.0, 724.0 / n * 0.5), 6) AS width FROM x"""
)
def chart_scales(spark, sf_dir):
    daily = usage.daily_summary(R.events(spark, sf_dir))  # a row for a day
    top = daily.agg(T.field_maximum("tokens_original").alias("top"), F.count("*").alias("n"))
    own = daily.withColumn("i", F.expr("row_number() OVER (ORDER BY day) - 1")).join(F.broadcast(top))  # one row
    y = T.linear_scale(F.col("tokens_original"), F.col("top"), 16.0, 186.0)
    x, width = T.slot_center(F.col("i"), F.col("n"), 38.0, 724.0), T.column_width(F.col("n"), 724.0)
    return own.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(y, 6).alias("y"), F.round(x, 6).alias("x"), F.round(width, 6).alias("width"))


_STAGE_WORDS = ["context", "Plan ", "ask", "REVISE", "ask/revise", "build", "recheck", "fix", "document", "review", "deploy", ""]


@query(f"SELECT item_id, CASE item_id % {len(_STAGE_WORDS)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(["'Context'", "'Plan'", "'Ask_Revise'", "'Ask_Revise'", "'Ask_Revise'", "'Build'", "'Test_Recheck'", "'Fix'", "'Proposal'", "'Proposal'"])) + " END AS stage FROM benchmark")
def stage_names(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, _STAGE_WORDS)), (F.col("item_id") % len(_STAGE_WORDS) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.stage_name(word).alias("stage"))


@query(
    f"""WITH {C._CHUNKS} SELECT 'chunk' AS kind, doc_id AS id, start_line, md5('passage: code in doc/' || doc_id || ' lines ' || start_line || '-' || end_line || ': ' || substr(chunk_text, 1, 512)) AS passage FROM chunks
    UNION ALL SELECT 'symbol', p_partkey, 0, md5('passage: part in ' || p_brand || ' — ' || p_type) FROM part"""
)
def passages(spark, sf_dir):
    own = chunks.chunk_windows(table(spark, sf_dir, "documents")).withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    one = own.select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("id"), "start_line", T.chunk_passage(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("chunk_text")).alias("text"))
    two = table(spark, sf_dir, "part").select(F.lit("symbol").alias("kind"), F.col("p_partkey").alias("id"), F.lit(0).alias("start_line"), T.symbol_passage(F.lit("part"), F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("text"))
    return one.unionByName(two).select("kind", "id", "start_line", F.md5(T.prefixed(F.col("text"), "passage").cast("binary")).alias("passage"))


@query("SELECT p_partkey, printf('%.1f%%', p_size / 1.0) AS share, round(1 / (1 + exp(-(p_size - 25) / 10.0)), 6) AS probability, '/my parts/' || p_brand AS path, p_name AS name FROM part")
def shown_scalars(spark, sf_dir):
    uri = F.concat(F.lit("file:///my%20parts/"), "p_brand")
    front = F.concat(F.lit("---\nkind: part\nname: '"), "p_name", F.lit("'\n---\n"))
    return table(spark, sf_dir, "part").select("p_partkey", T.percent_text(F.col("p_size")).alias("share"), F.round(T.sigmoid((F.col("p_size") - 25) / 10.0), 6).alias("probability"), T.file_uri_path(uri).alias("path"), T.frontmatter_name(front).alias("name"))


# Skills ------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT p_name AS name, p_brand || '/' || p_partkey AS relative_path, p_type AS content, 'embedded' AS source, 0 AS priority FROM part
        UNION ALL SELECT p_type, p_brand || '/' || p_partkey, p_name, 'local', 1 FROM part UNION ALL SELECT p_name, 'x/' || p_partkey, p_name, 'local', 1 FROM part)
    SELECT name, relative_path, content, source FROM x QUALIFY row_number() OVER (PARTITION BY name ORDER BY priority, relative_path) = 1"""
)
def skill_catalog(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    at = F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"))
    embedded = part.select(F.col("p_name").alias("name"), at.alias("relative_path"), F.col("p_type").alias("content"))
    local = part.select(F.col("p_type").alias("name"), at.alias("relative_path"), F.col("p_name").alias("content"))
    more = part.select(F.col("p_name").alias("name"), F.concat(F.lit("x/"), F.col("p_partkey").cast("string")).alias("relative_path"), F.col("p_name").alias("content"))
    return S.catalog([("embedded", embedded), ("local", local.unionByName(more))]).select("name", "relative_path", "content", "source")


@query("SELECT DISTINCT upper(c_mktsegment) AS name FROM customer WHERE upper(c_mktsegment) NOT IN (SELECT upper(p_type) FROM part)")
def new_skill_names(spark, sf_dir):
    local = table(spark, sf_dir, "customer").select(F.upper("c_mktsegment").alias("name")).distinct()
    return S.new_skills(local, table(spark, sf_dir, "part").select(F.upper("p_type").alias("name")))


@query(
    """WITH names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT c_name FROM customer UNION SELECT 'supplier/' || s_suppkey FROM supplier),
    a AS (SELECT p_name AS name, min(p_brand) AS c FROM part GROUP BY p_name), b AS (SELECT p_type AS name, min(p_name) AS c FROM part GROUP BY p_type),
    l AS (SELECT 'supplier/' || s_suppkey AS name, s_name AS c FROM supplier)
    SELECT n.name, CASE WHEN a.c IS NOT NULL THEN 'proposal' WHEN b.c IS NOT NULL THEN 'catalog' WHEN l.c IS NOT NULL THEN 'file' END AS origin, coalesce(a.c, b.c, l.c) AS content
    FROM names n LEFT JOIN a ON n.name = a.name LEFT JOIN b ON n.name = b.name LEFT JOIN l ON n.name = l.name"""
)
def requested_skills(spark, sf_dir):
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string"))
    names = part.select(F.col("p_name").alias("name")).union(part.select("p_type")).union(table(spark, sf_dir, "customer").select("c_name")).union(supplier.select(key))
    proposals = part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("content"))
    embedded = part.select(F.col("p_type").alias("name"), F.col("p_name").alias("content"))
    return S.requested(names, proposals, embedded, supplier.select(key.alias("path"), F.col("s_name").alias("content")))


_VECTOR_WORDS = R._word_sql([(k, round(100 * v)) for k, v in ranking.VECTOR_WORD_WEIGHTS.items()])


@query(
    rf"""WITH {R.SKILLS}, own AS (SELECT s.*, e.embedding AS v FROM skills s JOIN embeddings e ON CAST(string_split(shown, '-')[-1] AS BIGINT) = e.vec_id),
    asked AS (SELECT t.*, e.embedding AS qv FROM tasks t JOIN embeddings e ON t.query_id = e.vec_id),
    x AS (SELECT query_id, shown AS name, list_dot_product(CAST(qv AS DOUBLE[]), CAST(v AS DOUBLE[]))
        + CASE WHEN name = lower(text) THEN 0.5 WHEN contains(name, lower(text)) THEN 0.3 WHEN contains(intent, lower(text)) THEN 0.25 ELSE 0 END
        + coalesce(list_sum(list_transform(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''), lambda w: {_VECTOR_WORDS})), 0) / 100.0 AS score FROM own, asked)
    SELECT query_id, name, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM x QUALIFY rank <= 5"""
)
def vector_stage1(spark, sf_dir):
    vectors = R.vectors(spark, sf_dir)
    own = R.skills(spark, sf_dir).withColumn("id", F.element_at(F.split("name", "-"), -1).cast("long")).join(vectors, "id")
    asked = R.tasks(spark, sf_dir).join(vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), "query_id")
    found = ranking.stage_one(own, asked, 5, ranking.vector_score(F.col("text"), F.col("query_vector"), F.col("vector")))
    return found.select("query_id", "name", F.round("score", 6).alias("score"), "rank")


@query(
    rf"""WITH {R.SKILLS}, x AS (SELECT *, list_distinct(string_split_regex(lower(text), '\s+')) AS own, string_split_regex(content, '\s+') AS c FROM stage1 WHERE rank <= 8),
    y AS (SELECT query_id, shown AS name, 1 / (1 + exp(-(4.0 * len(list_intersect(own, c)) / greatest(len(own), 1) - 2.0))) + CASE WHEN contains(lower(text), lower(shown)) THEN 0.5 ELSE 0 END AS p FROM x)
    SELECT query_id, name, round(p, 6) AS probability FROM y WHERE p >= 0.35"""
)
def rerank_batch(spark, sf_dir):
    kept = ranking.rerank(ranking.stage_one(R.skills(spark, sf_dir), R.tasks(spark, sf_dir), 16), overlap_logit)
    return kept.select("query_id", "name", F.round("probability", 6).alias("probability"))


# Sections at headings ----------------------------------------------------------------

_HEADED = f"headed AS (SELECT doc_id, list_transform({R.LINES}, lambda x, i: CASE WHEN i % 6 = 3 THEN '## ' || x WHEN i % 11 = 1 THEN '#### ' || x WHEN i % 13 = 5 THEN '#' || x ELSE x END) AS lines FROM documents)"


def _headed(spark, sf_dir) -> DataFrame:
    """Documents in which every sixth line is a heading, and others look like one."""
    turn = lambda i, n, k: i % n == k
    lines = F.transform(T.lines_of(F.col("text")), lambda x, i: F.when(turn(i, 6, 2), F.concat(F.lit("## "), x)).when(turn(i, 11, 0), F.concat(F.lit("#### "), x)).when(turn(i, 13, 4), F.concat(F.lit("#"), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


_HEADINGS = rf"""{_HEADED}, rows AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM headed),
    marked AS (SELECT *, regexp_matches(line, '^#{{1,3}} ') AS h, sum(CAST(regexp_matches(line, '^#{{1,3}} ') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM rows),
    sections AS (SELECT doc_id, section, coalesce(max(regexp_replace(line, '^#{{1,3}} ', '')) FILTER (h), 'Overview') AS title, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT h) AS body, count(*) FILTER (NOT h) AS n_lines
        FROM marked GROUP BY ALL HAVING count(*) FILTER (NOT h) > 0)"""


@query(f"WITH {_HEADINGS} SELECT doc_id, section, md5(title) AS title, md5(body) AS body, n_lines FROM sections")
def markdown_sections(spark, sf_dir):
    own = documents.section_split(_headed(spark, sf_dir))
    return own.select("doc_id", "section", F.md5(F.col("title").cast("binary")).alias("title"), F.md5(F.col("body").cast("binary")).alias("body"), "n_lines")


@query(
    f"""WITH {_HEADINGS}, asked AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), n AS (SELECT count(*) AS n FROM embeddings),
    scored AS (SELECT s.*, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS score FROM sections s CROSS JOIN n CROSS JOIN asked JOIN embeddings e ON e.vec_id = (s.doc_id * 31 + s.section) % n.n)
    SELECT doc_id, section, md5(body) AS body, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section) <= 3"""
)
def vector_sections(spark, sf_dir):
    """The three sections of each document whose vectors, dealt to them by number, are closest to the first vector."""
    vectors = table(spark, sf_dir, "embeddings")
    q = C._one(spark, sf_dir)
    score = F.expr("aggregate(zip_with(embedding, q, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)")
    at = (F.col("doc_id") * 31 + F.col("section")) % F.lit(vectors.count())
    own = documents.section_split(_headed(spark, sf_dir)).withColumn("vec_id", at).join(vectors.select("vec_id", "embedding"), "vec_id").withColumn("q", F.array(*(F.lit(float(x)) for x in q)))
    return documents.section_slice_by_vector(own, score, 3).select("doc_id", "section", F.md5(F.col("body").cast("binary")).alias("body"), F.round("score", 6).alias("score"))


# Notes -------------------------------------------------------------------------------

_BARE = r"regexp_replace(line, '^\s*[-*] ', '')"
_NOTE_LINES = f"""rows AS (SELECT p_brand AS owner, p_partkey AS line_no, CASE p_size % 9 WHEN 0 THEN '## ' || p_type WHEN 1 THEN '# PINNED:' || p_type WHEN 2 THEN p_name ELSE '- ' || p_name END AS line FROM part),
    heads AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^#+ ') THEN {R.trim_sql("regexp_replace(line, '^#+ ', '')")} END IGNORE NULLS) OVER (PARTITION BY owner ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head FROM rows),
    notes AS (SELECT owner, line_no AS ord, {R.trim_sql("lower(coalesce(regexp_replace(head, '^PINNED:', '', 'i'), 'general'))")} AS category, {R.trim_sql(_BARE)} AS content,
        coalesce(starts_with(upper(head), 'PINNED:'), false) AS is_pinned FROM heads WHERE starts_with(line, '- '))"""


def _notes(spark, sf_dir) -> DataFrame:
    line = F.expr("CASE p_size % 9 WHEN 0 THEN concat('## ', p_type) WHEN 1 THEN concat('# PINNED:', p_type) WHEN 2 THEN p_name ELSE concat('- ', p_name) END")
    return learnings.parse(table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("line_no"), line.alias("line")))


@query(f"WITH {_NOTE_LINES} SELECT * FROM notes")
def notes_parse(spark, sf_dir):
    return _notes(spark, sf_dir)


@query(
    f"""WITH {_NOTE_LINES}, x AS (SELECT *, CASE WHEN is_pinned THEN 'PINNED:' ELSE '' END || category AS label FROM notes),
    y AS (SELECT *, lag(label) OVER (PARTITION BY owner ORDER BY is_pinned DESC, ord) AS before FROM x)
    SELECT owner, md5(string_agg(CASE WHEN before IS NULL OR before <> label THEN '# ' || label || chr(10) ELSE '' END || '- ' || content, chr(10) ORDER BY is_pinned DESC, ord)) AS text FROM y GROUP BY owner"""
)
def notes_render(spark, sf_dir):
    return learnings.render(_notes(spark, sf_dir)).select("owner", F.md5(F.col("text").cast("binary")).alias("text"))


# Maintenance -------------------------------------------------------------------------


@query(f"WITH {C._SNAPSHOTS}, d AS (SELECT CASE WHEN s.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN s.content_hash = c.content_hash THEN 'same' ELSE 'changed' END AS status FROM stored s FULL JOIN current c ON s.path = c.path) SELECT status, count(*) AS n FROM d GROUP BY ALL")
def index_report(spark, sf_dir):
    return merge.index_report(merge.diff(C._stored(spark, sf_dir), C._current(spark, sf_dir)))


@query(f"WITH {C._SNAPSHOTS}, {C._CHUNKS} SELECT doc_id, start_line FROM chunks WHERE 'doc/' || doc_id IN (SELECT path FROM current)")
def deletion_cascade(spark, sf_dir):
    gone = merge.diff(C._stored(spark, sf_dir), C._current(spark, sf_dir)).where("status = 'deleted'")
    own = chunks.chunk_windows(table(spark, sf_dir, "documents")).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), "doc_id", "start_line")
    return merge.without_paths(own, gone).select("doc_id", "start_line")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS session_id FROM orders WHERE epoch(CAST(o_orderdate AS TIMESTAMP)) >= (SELECT epoch(max(CAST(o_orderdate AS TIMESTAMP))) FROM orders) - 30 * 86400 ORDER BY o_orderdate DESC, session_id DESC LIMIT 100")
def session_gc(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("modified_at"))
    latest = own.agg(F.max("modified_at").alias("at")).first()["at"]
    return merge.session_gc(own, F.lit(latest)).select("session_id")


_TASK = "polish the large RING before a bolt"


@query(
    rf"""WITH words AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower('{_TASK}'), '\w+')) AS w) WHERE strlen(w) > 3),
    symbols AS (SELECT 'p' || p_partkey AS id, p_name AS name, 'doc/' || p_partkey AS file_path FROM part),
    hits AS (SELECT DISTINCT file_path FROM (SELECT file_path, row_number() OVER (PARTITION BY w ORDER BY id) AS n FROM symbols JOIN words ON contains(lower(name), w)) WHERE n <= 5)
    SELECT 'doc/' || doc_id AS file_path, len({C._LINES}) AS n_lines FROM documents WHERE 'doc/' || doc_id IN (SELECT file_path FROM hits) AND len({C._LINES}) >= 2"""
)
def split_candidates(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    key = F.col("p_partkey").cast("string")
    symbols = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key).alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("doc/"), key).alias("file_path"))
    return documents.split_candidates(files, symbols, _TASK, least=2).withColumn("n_lines", F.col("n_lines").cast("long"))


def _paths_sql() -> str:
    path = "regexp_replace(url, '^https?://', '')"
    bad = " OR ".join([*(f"p = '{n}' OR starts_with(p, '{n}/')" for n in S.IRRELEVANT), *(f"ends_with(p, '{e}')" for e in S.ENDINGS)])
    pruned = ", ".join(f"'{n}'" for n in S.PRUNED)
    return f"""WITH x AS (SELECT page_id, html, {path} AS p FROM pages)
        SELECT page_id, NOT ({bad}) AS relevant, NOT list_contains(string_split(p, '/'), '..') AND NOT starts_with(p, '/') AS safe,
               len(string_split(p, '/')) <= 8 AND len(list_filter(string_split(p, '/'), lambda s: starts_with(s, '.'))) = 0 AND NOT list_has_any(string_split(p, '/'), [{pruned}]) AS visible,
               strlen(html) <= {S.MOST_BYTES} AND NOT ends_with(p, '.min.js') AND NOT ends_with(p, '.lock') AS indexable FROM x"""


@query(_paths_sql())
def path_rules(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_replace("url", "^https?://", "").alias("p"))
    return own.select("page_id", S.relevant(F.col("p")).alias("relevant"), S.safe_relative(F.col("p")).alias("safe"), S.visible(F.col("p")).alias("visible"), S.indexable(F.col("p"), F.col("html")).alias("indexable"))


# Inline code base --------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_T = R.trim_sql("line")


def _starts(prefixes: list[str], text: str = "bare") -> str:
    return "(" + " OR ".join(f"starts_with({text}, {_quoted(p)})" for p in prefixes) + ")"


def _declared(what: str) -> str:
    if what == "kind":
        return "CASE " + " ".join(f"WHEN starts_with({_T}, '{p}') THEN '{k}'" for p, k in code.DECLARATIONS) + " END"
    return "CASE " + " ".join(rf"WHEN starts_with({_T}, '{p}') THEN regexp_extract(substr({_T}, {len(p) + 1}), '^([\p{{L}}\p{{N}}_]+)', 1)" for p, _ in code.DECLARATIONS) + " END"


_DECLARED = f"{R.CODE}, declared AS (SELECT path AS file_path, line_no AS start_line, line_no + 10 AS end_line, {_T} AS signature, {_declared('kind')} AS kind, {_declared('name')} AS name FROM rows), found AS (SELECT file_path || '::' || kind || '::' || name || '::L' || start_line AS id, * FROM declared WHERE coalesce(name, '') <> '')"
_IMPORTED = rf"imported AS (SELECT * FROM (SELECT path AS file_path, line_no AS line, regexp_replace(string_split_regex({_T}, '\s+')[2], ';+$', '') AS target_name, 'imports' AS edge_type FROM rows WHERE regexp_matches({_T}, '^(use|import|from) ')) WHERE target_name <> '')"
_CALLED = "called AS (SELECT r.path AS file_path, r.line_no AS line, f.id AS target_id, f.name AS target_name, 'calls' AS edge_type FROM rows r JOIN found f ON r.path = f.file_path AND r.line_no <> f.start_line AND contains(r.line, f.name || '('))"


@query(f"WITH {_DECLARED} SELECT id, name, kind, file_path, CAST(NULL AS VARCHAR) AS parent, start_line, end_line, signature FROM found")
def symbol_extract(spark, sf_dir):
    return code.symbols(R.code_files(spark, sf_dir))


@query(f"WITH {R.CODE}, {_IMPORTED} SELECT * FROM imported")
def import_edges(spark, sf_dir):
    return code.import_edges(R.code_files(spark, sf_dir))


@query(f"WITH {_DECLARED}, {_CALLED} SELECT * FROM called")
def call_edges(spark, sf_dir):
    return code.call_edges(R.code_files(spark, sf_dir))


@query(f"WITH {R.CODE} SELECT path, line_no, printf('L%04d: %s', line_no, {_T}) AS entry FROM rows WHERE " + _starts(code.LISTED, _T))
def file_listing(spark, sf_dir):
    return code.listing(R.code_files(spark, sf_dir))


_OUTLINED = f"""{R.CODE}, sized AS (SELECT path, text, len({R.LINES}) AS n FROM files),
    plain AS (SELECT r.path, n, line_no - 1 AS pos, line, {_T} AS bare FROM rows r JOIN sized s ON r.path = s.path WHERE n > {code.SHORT}),
    roles AS (SELECT *, contains(line, '{{') OR ends_with(bare, ':') AS opens, len(replace(line, '}}', '')) - len(replace(line, '{{', '')) AS step,
        CASE WHEN {_starts(code.COMMENTS + code.IMPORTS + code.TYPES)} OR (starts_with(bare, 'export ') AND NOT contains(bare, 'function') AND NOT contains(bare, '{{')) THEN 'stay'
             WHEN {_starts(code.FUNCTIONS)} OR ({_starts(code.METHODS)} AND contains(bare, '(')) THEN 'function'
             WHEN bare IN ('}}', '}};') OR starts_with(bare, 'pub ') OR (contains(bare, ':') AND NOT contains(bare, '(')) THEN 'stay' END AS role FROM plain),
    summed AS (SELECT *, sum(step) OVER (PARTITION BY path ORDER BY pos) AS bal,
        coalesce(min(CASE WHEN opens THEN pos END) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n - 1) AS head FROM roles),
    fns AS (SELECT f.path, f.pos AS first, f.head, f.n, f.line, contains(h.line, '{{') AS braced, h.bal - h.step AS level FROM summed f JOIN summed h ON f.path = h.path AND h.pos = f.head WHERE f.role = 'function'),
    spans AS (SELECT f.path, f.first, f.head, f.braced, f.line, CASE WHEN f.braced THEN coalesce(min(k.pos), f.n) ELSE f.head END AS last
        FROM fns f LEFT JOIN summed k ON k.path = f.path AND k.pos > f.head AND k.bal <= f.level GROUP BY f.path, f.first, f.head, f.braced, f.line, f.n),
    nexts AS (SELECT a.path, a.first, min(b.first) AS nxt FROM spans a LEFT JOIN spans b ON a.path = b.path AND b.first > a.last GROUP BY ALL),
    chosen AS (SELECT path, min(first) AS first FROM spans GROUP BY path UNION ALL SELECT x.path, x.nxt FROM chosen c JOIN nexts x ON x.path = c.path AND x.first = c.first WHERE x.nxt IS NOT NULL),
    signed AS (SELECT s.path, s.first, s.last, s.braced, s.line, string_agg(p.line, ' ' ORDER BY p.pos) AS sig
        FROM (SELECT * FROM spans SEMI JOIN chosen ON chosen.path = spans.path AND chosen.first = spans.first) s JOIN plain p ON p.path = s.path AND p.pos BETWEEN s.first AND s.head GROUP BY ALL),
    entries AS (SELECT path, first, last, CASE WHEN braced THEN substr(line, 1, len(line) - len(ltrim(line, '{SPACES}'))) || {R.trim_sql("regexp_extract(sig, '^[^{]*')")} || ' {{ /* L' || (first + 1) || '-' || (last + 1) || ': ' || greatest(1, last + 1 - first) || ' lines */ }}'
        ELSE {R.trim_sql("sig")} || ' /* L' || (first + 1) || ': implementation */' END AS entry FROM signed),
    kept AS (SELECT r.path, r.pos, CASE WHEN e.entry IS NOT NULL THEN e.entry WHEN r.role = 'stay' THEN r.line END AS line FROM roles r LEFT JOIN entries e ON e.path = r.path AND e.first = r.pos
        WHERE NOT EXISTS (SELECT 1 FROM entries c WHERE c.path = r.path AND r.pos > c.first AND r.pos <= c.last)),
    outlines AS (SELECT s.path, s.n, CASE WHEN s.n <= {code.SHORT} THEN s.text ELSE concat_ws(chr(10), '// === Structural Skeleton of ' || chr(39) || s.path || chr(39) || ' (Total Lines: ' || s.n || ') ===', k.body) END AS skeleton
        FROM sized s LEFT JOIN (SELECT path, string_agg(line, chr(10) ORDER BY pos) AS body FROM kept WHERE line IS NOT NULL GROUP BY path) k ON k.path = s.path)"""


@query(f"WITH RECURSIVE {_OUTLINED} SELECT path, n AS n_lines, md5(skeleton) AS skeleton FROM outlines")
def skeleton(spark, sf_dir):
    return code.skeletons(R.code_files(spark, sf_dir)).select("path", "n_lines", F.md5(F.col("skeleton").cast("binary")).alias("skeleton"))


@query(
    f"""WITH {R.CODE}, firsts AS (SELECT path, min(line_no) AS first FROM rows WHERE contains(line, 'class ') GROUP BY path),
    own AS (SELECT r.path, line, line_no - first AS k, {_T} = '' AS blank, len(line) - len(replace(line, '{{', '')) AS o, len(line) - len(replace(line, '}}', '')) AS c FROM rows r JOIN firsts f ON f.path = r.path WHERE line_no - first BETWEEN 0 AND 99),
    sums AS (SELECT *, sum(o) OVER w AS opened, sum(o - c) OVER w AS bal FROM own WINDOW w AS (PARTITION BY path ORDER BY k)),
    ends AS (SELECT path, min(k) AS last FROM sums WHERE (k > 0 AND opened > 0 AND bal <= 0 AND (blank OR c > 0)) OR (k >= 29 AND opened = 0 AND blank) GROUP BY path)
    SELECT s.path, string_agg(line, chr(10) ORDER BY k) AS snippet FROM sums s LEFT JOIN ends e ON e.path = s.path WHERE k <= coalesce(last, 99) GROUP BY s.path"""
)
def target_symbol(spark, sf_dir):
    return code.target_symbols(R.code_files(spark, sf_dir), "class ")


@query(
    rf"""WITH RECURSIVE {_OUTLINED}, raw AS (SELECT o.path, o.n, CASE WHEN o.n > 20 THEN o.skeleton ELSE array_to_string(({R.LINES.replace("text", "f.text")})[1:20], chr(10)) END AS text FROM outlines o JOIN files f ON f.path = o.path),
    cut AS (SELECT path, n, list_transform({R.LINES}, lambda x: regexp_replace(x, '\s+$', '')) AS own FROM raw)
    SELECT path, n AS n_lines, false AS capped, md5(coalesce(array_to_string(list_filter(own, lambda x, i: NOT (x = '' AND coalesce(own[i - 1], 'x') = '')), chr(10)), '')) AS view FROM cut"""
)
def bounded_view(spark, sf_dir):
    own = code.bounded_read(R.code_files(spark, sf_dir), most=20)
    return own.select("path", "n_lines", "capped", F.md5(F.col("view").cast("binary")).alias("view"))
