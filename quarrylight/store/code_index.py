"""The stored code index: files, symbols, references and chunks by path, and two full-text indexes.

Every table is bucketed by the hash of the path its rows derive from, so what a changed
file leaves behind lies in one bucket of each. A refresh compares content hashes, reads the
text of files that are new or changed, and rewrites the buckets of changed paths: rows of
other paths of those buckets are copied from the version before. Full-text indexes get
tombstones for units of changed paths and a segment of new ones.

References are kept as they are written, by name, with the symbol they occur in; edges are
made when they are read, by one join on names. So a symbol that moves, comes or goes in one
file changes no row of the files that refer to it, and edges are always those of a full
index. Opening a store and asking it reads its tables and no text of any file.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import chunks, code, graph, merge
from ..sources.files import indexable
from .buckets import Change, Store
from .fulltext import FullText


def derived(files: DataFrame) -> dict[str, DataFrame]:
    """Rows of files (path, content) that can be indexed, by table."""
    own = files.where(indexable(F.col("path"), F.col("content")))
    symbols, near = code.symbols(own), own.repartition("path")  # a file's lines, names and uses meet where the file is
    inside = code.symbols(near)
    raw = code.import_edges(near).unionByName(code.called_names(near, inside))
    windows = chunks.chunk_windows(own.select(F.col("path").alias("doc_id"), F.col("content").alias("text")))
    return {
        "files": own.select("path", content_hash(F.col("content")).alias("content_hash"), F.octet_length("content").cast("long").alias("size")),
        "symbols": symbols,
        "references": graph.enclosed(raw, inside),
        "chunks": windows.select(F.xxhash64("doc_id", "start_line").alias("id"), F.col("doc_id").alias("file_path"), "start_line", "end_line", content_hash(F.col("chunk_text")).alias("content_hash"), "chunk_text"),
    }


#: The column of each table that names the path.
TABLES = {"files": "path", "symbols": "file_path", "references": "file_path", "chunks": "file_path"}
TEXTS = {"symbols": lambda: F.concat_ws(" ", "name", "kind", "signature"), "chunks": lambda: F.concat_ws(" ", "file_path", "chunk_text")}


class CodeIndex:
    """An index below a folder; every change returns the index of the next version."""

    def __init__(self, store: Store, buckets: int):
        self.store, self.buckets = store, buckets

    @staticmethod
    def start(change: Change, buckets: int) -> CodeIndex:
        """An index without files, as part of the first change of a store."""
        spark = change.before.spark
        change.values["buckets"] = buckets
        for name, rows in derived(spark.createDataFrame([], "path string, content string")).items():
            change.write(name, rows, TABLES[name], buckets)
        return CodeIndex(change.commit(), buckets)

    @staticmethod
    def build(spark: SparkSession, root: str, files: DataFrame, *, buckets: int = 64) -> CodeIndex:
        """A full index of files (path, content) in an empty folder."""
        store = Store(spark, root)
        if store.version:
            raise ValueError(f"{root} holds version {store.version}")
        change = store.change()
        change.values["buckets"] = buckets
        index = CodeIndex(store, buckets)
        for name, rows in derived(index._read_once(change, files)).items():
            change.write(name, rows, TABLES[name], buckets)
        index._forget(change)
        return index._indexed(change, None)

    @staticmethod
    def open(spark: SparkSession, root: str, version: int | None = None) -> CodeIndex:
        store = Store(spark, root, version)
        if not store.version:
            raise ValueError(f"{root} holds no index")
        return CodeIndex(store, store.values["buckets"])

    # Tables ----------------------------------------------------------------------------

    @property
    def files(self) -> DataFrame:
        return self.store.read("files")

    @property
    def symbols(self) -> DataFrame:
        return self.store.read("symbols")

    @property
    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    @property
    def edges(self) -> DataFrame:
        """source_id, target_id, edge_type between symbols."""
        return graph.named_edges(self.store.read("references"), self.symbols)

    def of_paths(self, name: str, paths: list[str] | DataFrame) -> DataFrame:
        """Rows of a table that derive from some paths; reads their buckets alone."""
        key = TABLES[name]
        asked = self._named(paths).select(F.col("path").alias(key)).distinct()
        return self.store.read(name, self.store.buckets_of(name, asked)).join(asked, key, "left_semi")

    def _named(self, paths: list[str] | DataFrame) -> DataFrame:
        return paths.select("path") if isinstance(paths, DataFrame) else self.store.spark.createDataFrame([(p,) for p in paths], "path string")

    # Changes ---------------------------------------------------------------------------

    def _both(self, files: DataFrame, paths: list[str] | DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """path and content_hash of what is stored and of files that can be indexed, of some paths or all."""
        current = files.where(indexable(F.col("path"), F.col("content"))).select("path", content_hash(F.col("content")).alias("content_hash"))
        if paths is None:
            return self.files.select("path", "content_hash"), current
        return self.of_paths("files", paths).select("path", "content_hash"), current.join(self._named(paths), "path", "left_semi")

    def changes(self, files: DataFrame, paths: list[str] | DataFrame | None = None) -> DataFrame:
        """path, status (added, changed, deleted) of files against the index, of some paths or all."""
        return merge.diff(*self._both(files, paths)).where("status <> 'same'")

    def refresh(self, files: DataFrame, paths: list[str] | DataFrame | None = None, also: Callable[[Change], None] | None = None) -> tuple[CodeIndex, DataFrame]:
        """The next version after changes, and the changes; without any, this version.

        paths: if given, only these are looked at. also: writes more into the same version, which then is made in any case.
        """
        return self._apply(files, self.changes(files, paths), also)

    def reindex(self, files: DataFrame, paths: list[str] | DataFrame | None = None) -> tuple[CodeIndex, DataFrame]:
        """The same with files that did not change read again as well."""
        every = merge.diff(*self._both(files, paths))
        return self._apply(files, every.select("path", F.when(F.col("status") == "same", "changed").otherwise(F.col("status")).alias("status")))

    def _apply(self, files: DataFrame, changes: DataFrame, also: Callable[[Change], None] | None = None) -> tuple[CodeIndex, DataFrame]:
        change = self.store.change()
        change.write("changes", changes, "path", self.buckets)  # decided once; what follows reads it
        changed = change.read("changes")
        touched = change.written["changes"]  # all tables have the same buckets
        if not touched and also is None:
            self.store.folder.delete(f"changes/v={change.mark}")
            return self, changed
        if also is not None:
            also(change)
        if not touched:
            return CodeIndex(change.commit(), self.buckets), changed
        fresh = derived(self._read_once(change, files.join(changed.where("status <> 'deleted'").select("path"), "path", "left_semi")))
        for name, key in TABLES.items():
            old = merge.without_paths(self.store.read(name, touched), changed.select("path"), key)
            change.write(name, old.unionByName(fresh[name]), key, self.buckets, touched)
        self._forget(change)
        return self._indexed(change, changed), changed

    def _read_once(self, change: Change, files: DataFrame) -> DataFrame:
        """Files that can be indexed as they are now, kept until ``_forget``: every table derives from the same text, which is read (or made) once."""
        path = f"{self.store.folder.root}/_scratch/{change.mark}-files"
        files.select("path", "content").where(indexable(F.col("path"), F.col("content"))).write.option("compression", "zstd").parquet(path)
        return self.store.spark.read.schema("path string, content string").parquet(path)

    def _forget(self, change: Change) -> None:
        self.store.folder.delete(f"_scratch/{change.mark}-files")

    def _indexed(self, change: Change, changed: DataFrame | None) -> CodeIndex:
        """Commits after both full-text indexes followed."""
        for name, text in TEXTS.items():
            index = FullText(self.store, f"text_{name}", ["id", "file_path"], self.buckets)
            rows = change.read(name, change.written[name])
            if changed is not None:
                paths = changed.select(F.col("path").alias("file_path"))
                index.remove(change, paths)
                rows = rows.join(paths, "file_path", "left_semi")
            index.add(change, rows, text())
        return CodeIndex(change.commit(), self.buckets)

    def compact(self) -> CodeIndex:
        change = self.store.change()
        for name in TEXTS:
            self.text(name).compact(change)
        return CodeIndex(change.commit(), self.buckets)

    # Questions -------------------------------------------------------------------------

    def text(self, name: str) -> FullText:
        return FullText(self.store, f"text_{name}", ["id", "file_path"], self.buckets)

    def match(self, name: str, terms: DataFrame) -> DataFrame:
        """query_id, id, file_path of symbols or chunks that hold all terms of a query (query_id, term)."""
        return self.text(name).match(terms)

    def related(self, needle: str, limit: int = 20) -> DataFrame:
        return graph.related(self.edges, self.symbols, needle, limit)

    def report(self) -> DataFrame:
        """table, n: rows of each table."""
        return reduce(DataFrame.unionByName, (self.store.read(n).agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n in TABLES))
