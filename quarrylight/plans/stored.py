"""Queries over stored indexes: built from the driver's tables, changed, and asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..store.buckets import Store
from ..store.code_index import CodeIndex
from ..store.fulltext import FullText
from . import more as M
from . import tables as R
from .registered import query


@query(f"WITH {R.INDEX}, {R.TERMS}, {R.match_sql('idx', 'doc_id', 'hits')} SELECT query_id, doc_id FROM hits")
def stored_fts(spark, sf_dir):
    """Whole documents, of which labelled ones were first indexed with a stale text, then replaced; asked from the store."""
    docs, root = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark, "fulltext")
    stale = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    change = Store(spark, root).change()
    FullText(change.before, "docs", ["doc_id"], 16).add(change, docs.join(stale.select("doc_id"), "doc_id", "left_anti").unionByName(stale.withColumn("text", F.reverse("text"))), F.col("text"))
    store = change.commit()
    own, change = FullText(store, "docs", ["doc_id"], 16), store.change()
    own.remove(change, stale.select("doc_id"))
    own.add(change, stale, F.col("text"))
    return FullText(change.commit(), "docs", ["doc_id"]).match(R.queries(spark, sf_dir))


@query(
    rf"""WITH {M._DECLARED}, {M._IMPORTED}, {M._CALLED},
    uses AS (SELECT file_path, line, target_name, edge_type FROM imported UNION ALL SELECT file_path, line, target_name, edge_type FROM called),
    enclosed AS (SELECT u.file_path, u.line, u.target_name, u.edge_type, arg_max(f.id, f.start_line) AS source_id FROM uses u JOIN found f ON f.file_path = u.file_path AND f.start_line <= u.line GROUP BY ALL),
    refs AS (SELECT DISTINCT file_path, source_id, target_name, edge_type FROM enclosed),
    windows AS (SELECT path, lines, unnest(range(0, len(lines), 40)) AS p FROM (SELECT path, {R.LINES} AS lines FROM files) WHERE len(lines) > 0),
    chunks AS (SELECT path FROM windows WHERE len(list_filter(lines[p + 1:p + 50], lambda x: {R.trim_sql("x")} <> '')) >= 3)
    SELECT path, substr(md5(text), 1, 16) AS content_hash, (SELECT count(*) FROM found WHERE file_path = path) AS n_symbols,
           (SELECT count(*) FROM refs WHERE file_path = path) AS n_references, (SELECT count(*) FROM chunks c WHERE c.path = f.path) AS n_chunks FROM files f"""
)
def stored_index(spark, sf_dir):
    """The code index after a refresh: labelled documents' files were other ones before, and files of the source "gone" went."""
    files, root = R.code_files(spark, sf_dir), shared_folder(spark, "code-index")
    labelled = F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".rs"))
    stale = files.join(table(spark, sf_dir, "labels").select(labelled.alias("end")).distinct(), F.expr("concat('/', substring_index(path, '/', -1)) = end"), "left_semi")
    gone = stale.withColumn("path", F.concat(F.lit("gone/"), "path"))
    before = files.join(stale.select("path"), "path", "left_anti").unionByName(stale.withColumn("content", F.concat(F.lit("fn stale() {\n"), "content"))).unionByName(gone)
    index, _ = CodeIndex.build(spark, root, before, buckets=16).refresh(files)
    count = lambda name, column: index.store.read(name).groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias(column))
    out = index.files.select("path", "content_hash")
    for name, column in (("symbols", "n_symbols"), ("references", "n_references"), ("chunks", "n_chunks")):
        out = out.join(count(name, column), "path", "left").withColumn(column, F.coalesce(column, F.lit(0)).cast("long"))
    return out
