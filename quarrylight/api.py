"""The library's calls: index a corpus, keep it fresh, search it, find skills for tasks.

``index`` derives tables that live as long as the session; ``CodeIndex`` stores them, with the
same search.

Every call takes DataFrames and returns DataFrames; nothing is refreshed or learned
behind a query's back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import content_hash, expand_query, matches_filter
from .operators import aliases, chunks, code, documents, merge, ranking, search, vector_search
from .operators.graph import resolve_edges
from .sources.files import find_skill, indexable
from .sources.providers import hashing_embedding, overlap_logit
from .store.code_index import CodeIndex


@dataclass
class Index:
    """Tables derived from source files."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    chunks: DataFrame
    symbol_terms: DataFrame
    chunk_terms: DataFrame

    def match(self, kind: str, terms: DataFrame) -> DataFrame:
        """query_id, id, file_path of symbols or chunks that hold all terms of a query."""
        return chunks.match_all(self.symbol_terms if kind == "symbols" else self.chunk_terms, terms, ["id", "file_path"])


def index(files: DataFrame) -> Index:
    """A full index of files (path, content)."""
    own = files.where(indexable(F.col("path"), F.col("content")))
    listed = own.select("path", content_hash(F.col("content")).alias("content_hash"), F.octet_length("content").cast("long").alias("size"))
    symbols = code.symbols(own)
    raw = code.import_edges(own).unionByName(code.call_edges(own).select("file_path", "line", "target_name", "edge_type"))
    parts = chunks.chunk_windows(own.select(F.col("path").alias("doc_id"), F.col("content").alias("text")))
    parts = parts.select(F.xxhash64("doc_id", "start_line").alias("id"), F.col("doc_id").alias("file_path"), "start_line", "end_line", content_hash(F.col("chunk_text")).alias("content_hash"), "chunk_text")
    named = F.concat_ws(" ", "name", "kind", "signature")
    return Index(listed, symbols, resolve_edges(raw, symbols), parts, chunks.postings(symbols, ["id", "file_path"], named), chunks.postings(parts, ["id", "file_path"], F.concat_ws(" ", "file_path", "chunk_text")))


def refresh(old: Index, files: DataFrame, paths: list[str] | None = None) -> tuple[Index, DataFrame]:
    """The index after changes, and the differences. Only new and changed files are read again; deleted ones leave every table.

    paths: if given, only these are looked at.
    """
    current = files.select("path", content_hash(F.col("content")).alias("content_hash"))
    stored = old.files
    if paths is not None:
        current, stored = current.where(F.col("path").isin(paths)), stored.where(F.col("path").isin(paths))
    changes = merge.diff(stored.select("path", "content_hash"), current).where("status <> 'same'")
    fresh = index(files.join(changes.where("status <> 'deleted'").select("path"), "path", "left_semi"))
    touched = changes.select("path")

    def both(a: DataFrame, b: DataFrame, column: str = "file_path") -> DataFrame:
        return merge.refresh_rows(a, b, touched, column)

    symbols = both(old.symbols, fresh.symbols)
    live = old.edges.join(symbols.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(symbols.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    edges = live.select("source_id", "target_id", "edge_type").unionByName(fresh.edges).distinct()
    return Index(both(old.files, fresh.files, "path"), symbols, edges, both(old.chunks, fresh.chunks), both(old.symbol_terms, fresh.symbol_terms), both(old.chunk_terms, fresh.chunk_terms)), changes


def report(changes: DataFrame) -> DataFrame:
    return merge.index_report(changes)


def search_context(own: Index | CodeIndex, queries: DataFrame, known: DataFrame, symbol_vectors: DataFrame | None = None, chunk_vectors: DataFrame | None = None, *, embed=hashing_embedding, at_least: tuple[float, float] = (0.65, 0.60)) -> DataFrame:
    """The cascade over an index, stored or not, for queries (query_id, text): aliases, symbols, symbol vectors, content, content vectors."""
    terms = chunks.query_terms(queries, F.col("text"))

    def found(kind: str) -> DataFrame:
        hits = own.match(kind, terms)
        return hits.select("query_id", F.col("file_path").alias("path"), F.lit(0.0).alias("score")).distinct()

    close = aliases.lookup_batch(known, queries).select("query_id", F.col("resolved_path").alias("path"), F.col("confidence").alias("score"))
    phases = [(close, 10), (found("symbols"), 15)]

    def near(vectors: DataFrame | None, threshold: float) -> list[tuple[DataFrame, int]]:
        if vectors is None:
            return []
        asked = queries.select("query_id", embed(F.col("text")).alias("vector"))
        best = vector_search.batch_top_k(vectors.select("id", "vector"), asked, 10, threshold=threshold)
        return [(best.join(vectors.select("id", "path"), "id").select("query_id", "path", "score"), 10)]

    phases += near(symbol_vectors, at_least[0])
    phases.append((found("chunks"), 10))
    phases += near(chunk_vectors, at_least[1])
    return search.cascade(phases)


def learn_aliases(known: DataFrame, results: DataFrame, queries: DataFrame, at: Column) -> DataFrame:
    """The alias table after the best path of each answered query became an alias of it."""
    return aliases.upsert(known, aliases.learn(results, queries, at))


def search_skills(skills: DataFrame, tasks: DataFrame, *, languages: list[str] | None = None, techniques: list[str] | None = None, logit=overlap_logit, first: int = 16, last: int = 8) -> DataFrame:
    """Two-stage search: the first stage's best, those that suit the project, reranked, one for each name."""
    one = ranking.stage_one(skills, tasks, first)
    suits = ranking.affinity(F.col("text"), F.array(*map(F.lit, languages or [])).cast("array<string>"), F.array(*map(F.lit, techniques or [])).cast("array<string>"))
    kept = one.where(suits)
    two = ranking.rerank(kept, logit).withColumn("final", F.col("probability")) if logit else ranking.stage_two(kept)
    named = two.withColumn("_n", F.expr("row_number() OVER (PARTITION BY query_id, name ORDER BY final DESC, relative_path)")).where("_n = 1").drop("_n")
    return named.withColumn("place", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY final DESC, name)")).where(F.col("place") <= last)


def search_docs(skills: DataFrame, tasks: DataFrame, *, logit=overlap_logit) -> DataFrame:
    """The same with a narrower funnel: five, then three."""
    return search_skills(skills, tasks, logit=logit, first=5, last=3)


PREVIEWED, REMEMBERED, CLOSE = 15, 3, 0.82


def task_pipeline(
    skills: DataFrame,
    task: str,
    *,
    focus: str | None = None,
    phase: str = "plan",
    files: DataFrame | None = None,
    symbols: DataFrame | None = None,
    notes: DataFrame | None = None,
    rules: DataFrame | None = None,
    embed: Callable[[Column], Column] = hashing_embedding,
) -> dict[str, DataFrame]:
    """Skills for a task, the profile of the project, files worth splitting, a preview of its tree, notes close to the task and the phase's rules.

    files: path, content. notes: ord, category, content, vector. rules: group, rule.
    """
    spark = skills.sparkSession
    asked = spark.createDataFrame([(0, task, focus, phase)], "query_id long, task string, focus string, phase string")
    tasks = asked.select("query_id", expand_query(F.col("task"), F.col("focus"), F.col("phase")).alias("text"))
    out = {"skills": search_skills(skills, tasks)}
    if files is not None:
        out["profile"] = documents.language_profile(files, task)
        out["architecture"] = documents.architecture(files)
        out["tree"] = files.select("path").orderBy("path").limit(PREVIEWED)
        out["split"] = documents.split_candidates(files, symbols if symbols is not None else code.symbols(files), task)
    if notes is not None:
        query = asked.select(embed(F.col("task")).alias("v")).first()["v"]  # one vector
        out["notes"] = ranking.rank_learnings(notes, F.array(*(F.lit(float(x)) for x in query)), REMEMBERED, CLOSE)
    if rules is not None:
        out["rules"] = documents.phase_rules(spark.createDataFrame([(phase,)], "phase string"), rules)
    return out


def read_document(docs: DataFrame, task: str, k: int = 3, embed: Callable[[Column], Column] | None = hashing_embedding) -> DataFrame:
    """doc_id, text: the sections of each document (doc_id, text) that are closest to a task."""
    return documents.sliced(docs, task, k, embed)


def list_skills(skills: DataFrame, needle: str = "") -> DataFrame:
    """name, relative_path of skills whose name or path contains the text, in any case, by name."""
    return skills.where(matches_filter(needle, "name", "relative_path")).select("name", "relative_path").orderBy("name", "relative_path")


def get_skill(skills: DataFrame, assets: DataFrame, name: str) -> DataFrame:
    """name, origin, content: the skill of a name or path, else the workflow asset (path, content) of that path or file name."""
    own = find_skill(skills, name).select("name", F.lit("skill").alias("origin"), "content", F.lit(0).alias("_at"))
    hit = (F.col("path") == name) | F.endswith("path", F.lit("/" + name)) | F.endswith("path", F.lit("/" + name + ".md"))
    other = assets.where(hit).select(F.col("path").alias("name"), F.lit("asset").alias("origin"), "content", F.lit(1).alias("_at"))
    return own.unionByName(other).orderBy("_at", F.length("name"), "name").limit(1).drop("_at")
