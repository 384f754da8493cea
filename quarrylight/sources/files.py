"""Sources: directory trees, skill catalogs, notes, sessions, binary vector files."""

from __future__ import annotations

import struct
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bytes_of, frontmatter_name, slug

# Directories that a walk leaves out, those of relevance, and endings that are not indexed.
PRUNED = [".git", ".agent-context", "target", "node_modules", ".gradle", "build", "dist", ".next", "vendor", ".venv", ".cache", "__pycache__", ".turbo", "out"]
IRRELEVANT = [".git", ".agent-context", "target", "node_modules", ".gradle", "build", "__pycache__", ".mypy_cache", "dist", ".next", ".nuxt"]
ENDINGS = [".lock", ".min.js", ".min.css", ".map", ".png", ".jpg", ".gif", ".ico", ".woff", ".woff2", ".exe", ".dll", ".so", ".dylib"]
# Directories and files that hold no skills.
NO_SKILLS = [".git", ".github", "node_modules", "target", "assets", "img", "images", "dist", "build", "references", "scripts", "__pycache__", "vendor", "docs"]
NOT_SKILLS = ["readme.md", "changelog.md", "contributing.md", "license.md", "index.md", "template.md", "_template.md", "security.md", "code_of_conduct.md", "authors.md"]
MOST_BYTES = 102_400


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def visible(path: Column, max_depth: int = 8) -> Column:
    """Not hidden, not in a pruned directory, not too deep."""
    parts = _parts(path)
    return (F.size(parts) <= max_depth) & ~F.exists(parts, lambda p: F.startswith(p, F.lit("."))) & (F.size(F.array_intersect(parts, F.array(*map(F.lit, PRUNED)))) == 0)


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """path, content of whole text files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.col("content").cast("string").alias("content"))


def indexable(path: Column, content: Column) -> Column:
    return (bytes_of(content) <= MOST_BYTES) & ~F.endswith(path, F.lit(".min.js")) & ~F.endswith(path, F.lit(".lock"))


def relevant(path: Column) -> Column:
    """Whether a change of a path (below the root) matters."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = F.lit(False)
    for name in IRRELEVANT:
        bad = bad | (clean == name) | F.startswith(clean, F.lit(name + "/"))
    for ending in ENDINGS:
        bad = bad | F.endswith(clean, F.lit(ending))
    return ~bad


def safe_relative(path: Column) -> Column:
    """Whether a path stays inside its root."""
    return ~F.exists(_parts(path), lambda p: p == "..") & ~F.startswith(path, F.lit("/"))


def skills(files: DataFrame) -> DataFrame:
    """name, relative_path, content of skills in a tree (path, content).

    A directory that holds SKILL.md is one skill and nothing below it is another; a
    directory named cheatsheets gives a skill for each of its Markdown files.
    """
    parts, low = _parts(F.col("path")), F.lower(F.element_at(_parts(F.col("path")), -1))
    folders = F.slice(parts, 1, F.size(parts) - 1)
    own = files.where(F.size(F.array_intersect(folders, F.array(*map(F.lit, NO_SKILLS)))) == 0)
    own = own.withColumn("folder", F.array_join(folders, "/")).withColumn("file", F.element_at(parts, -1)).withColumn("low", low)
    leaves = own.where("file = 'SKILL.md'")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders) - 1, F.lit(1))), lambda n: F.array_join(F.slice(folders, 1, n), "/"))
    nested = leaves.where(F.size(folders) > 1).select("path", F.explode(above).alias("folder")).join(leaves.select("folder"), "folder").select("path").distinct()
    tops = leaves.join(nested, "path", "left_anti")
    named = tops.select(F.coalesce(frontmatter_name(F.col("content")), F.element_at(folders, -1), F.lit("custom-skill")).alias("name"), "path", "content")
    sheets = own.where((F.element_at(folders, -1) == "cheatsheets") & F.endswith("low", F.lit(".md")) & ~F.col("low").isin(NOT_SKILLS) & (F.col("file") != "SKILL.md"))
    sheets = sheets.select(F.replace(F.regexp_replace("file", r"(?i)\.md$", ""), F.lit("_"), F.lit("-")).alias("name"), "path", "content")
    return named.unionByName(sheets).select(slug(F.col("name")).alias("name"), F.col("path").alias("relative_path"), "content")


def catalog(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of skill tables; of a name the first source's row stays, and in it the first path's."""
    every = None
    for priority, (source, rows) in enumerate(sources):
        own = rows.select("name", "relative_path", "content").withColumn("source", F.lit(source)).withColumn("priority", F.lit(priority))
        every = own if every is None else every.unionByName(own)
    w = Window.partitionBy("name").orderBy("priority", "relative_path")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "priority")


def find_skill(rows: DataFrame, name: str) -> DataFrame:
    """The skill of a name, or of a path with the usual endings; the first form that is there."""
    forms = [name, f"{name}/SKILL.md", f"skills/{name}/SKILL.md", f"{name}.md"]
    place = F.when(F.col("name") == name, 0)
    for i, form in enumerate(forms):
        place = place.when(F.col("relative_path") == form, i + 1)
    return rows.withColumn("_at", place).where(F.col("_at").isNotNull()).orderBy("_at", "relative_path").limit(1).drop("_at")


def requested(names: DataFrame, proposals: DataFrame, embedded: DataFrame, local: DataFrame) -> DataFrame:
    """name, origin, content of each requested name: the first of proposals, the embedded catalog and local files that has it; origin is null if none has.

    proposals and embedded: name, content; local: path, content, looked up by path.
    """
    out, first = names.select("name").distinct(), []
    for i, (origin, rows, key) in enumerate((("proposal", proposals, "name"), ("catalog", embedded, "name"), ("file", local, "path"))):
        own = rows.groupBy(F.col(key).alias("name")).agg(F.min("content").alias(f"c{i}"))
        out = out.join(own, "name", "left")
        first.append((F.col(f"c{i}"), origin))
    origin = F.coalesce(*(F.when(c.isNotNull(), o) for c, o in first))
    return out.select("name", origin.alias("origin"), F.coalesce(*(c for c, _ in first)).alias("content"))


def new_skills(local: DataFrame, embedded: DataFrame) -> DataFrame:
    return local.join(embedded.select("name"), "name", "left_anti")


def sessions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Session documents, newest first; those that are no JSON of the schema are left out."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    named = raw.select("*", F.col("_metadata.file_modification_time").alias("modified_at"), F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file_id"))
    return named.where("session_id IS NOT NULL").orderBy(F.desc("modified_at"), "session_id")


def session_by_id(spark: SparkSession, folder: str, session_id: str, schema: str) -> DataFrame:
    """The session whose file has that name, which must name a file below the folder; an error that tells corrupted from missing."""
    if not session_id or session_id.startswith("/") or any(p in ("", ".", "..") for p in session_id.replace("\\", "/").split("/")):
        raise ValueError(f"{session_id!r} names no session")
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.endswith("path", F.lit(f"/{session_id}.json")))
    texts = own.select(F.col("content").cast("string").alias("text"), F.from_json(F.col("content").cast("string"), schema, {"mode": "PERMISSIVE"}).alias("session")).limit(1)
    found = texts.collect()  # one row
    if not found:
        raise KeyError(f"no session {session_id!r} in {folder}")
    if found[0]["session"] is None or found[0]["session"]["session_id"] is None:
        raise ValueError(f"the file of session {session_id!r} is corrupted")
    return texts.select("session.*")


def newest_session(spark: SparkSession, folder: str, schema: str, legacy: str | None = None) -> DataFrame:
    """The newest session of a folder; if there is none, that of the legacy file; else no rows."""
    own = sessions(spark, folder, schema).drop("modified_at", "file_id").limit(1)
    if legacy and own.isEmpty():
        own = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(legacy).where("session_id IS NOT NULL").limit(1)
    return own


class Snapshot:
    """Tables of a project, kept in memory until a directory's stamp changes or they are older than ``seconds``.

    make: returns the tables by name; stamp: what their sources look like now, such as modification times.
    """

    def __init__(self, make: Callable[[], dict[str, DataFrame]], stamp: Callable[[], object], seconds: float = 2.0, clock: Callable[[], float] = time.monotonic):
        self.make, self.stamp, self.seconds, self.clock = make, stamp, seconds, clock
        self.held: tuple[float, object, dict[str, DataFrame]] | None = None

    def tables(self) -> dict[str, DataFrame]:
        now, stamp = self.clock(), self.stamp()
        if self.held is None or now - self.held[0] > self.seconds or self.held[1] != stamp:
            self.invalidate()
            self.held = (now, stamp, {k: df.persist() for k, df in self.make().items()})
        return self.held[2]

    def invalidate(self) -> None:
        if self.held is not None:
            for df in self.held[2].values():
                df.unpersist()
            self.held = None


def decode_vectors(content: bytes) -> np.ndarray:
    """Vectors of a binary file: count and dimension, then 32-bit floats, all little-endian."""
    if len(content) < 8:
        raise ValueError("a vector file has a header of eight bytes")
    count, dim = struct.unpack_from("<II", content)
    if len(content) != 8 + 4 * count * dim:
        raise ValueError(f"{count} vectors of {dim} take {8 + 4 * count * dim} bytes, the file has {len(content)}")
    return np.frombuffer(content, "<f4", count * dim, 8).reshape(count, dim)


def encode_vectors(vectors: np.ndarray) -> bytes:
    a = np.asarray(vectors, "<f4")
    return struct.pack("<II", *a.shape) + a.tobytes()


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, vector of binary vector files."""

    def make(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                own = decode_vectors(bytes(content))
                yield pd.DataFrame({"path": name, "ord": np.arange(len(own)), "vector": list(own)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(make, "path string, ord long, vector array<float>")


def vector_bytes(vector: Column) -> Column:
    """32-bit little-endian bytes of a vector, in batches."""

    @F.pandas_udf("binary")
    def make(own: pd.Series) -> pd.Series:
        return own.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return make(vector)


def bytes_vector(content: Column) -> Column:
    @F.pandas_udf("array<float>")
    def make(own: pd.Series) -> pd.Series:
        return own.map(lambda b: None if b is None else np.frombuffer(bytes(b), "<f4"))

    return make(content)
