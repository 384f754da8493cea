"""Stored tables, the stored full-text index and the stored code index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrylight import api
from quarrylight.operators import chunks
from quarrylight.plans import fixtures
from quarrylight.store.buckets import Conflict, Store
from quarrylight.store.code_index import TABLES, CodeIndex
from quarrylight.store.fulltext import BITS, FullText


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def folders(store):
    return {(n, b, f) for n, t in store.tables.items() for b, f in t.at.items()}


def paths_read(df):
    return [str(f) for f in df._jdf.queryExecution().optimizedPlan().toString().split() if f.startswith("file:")] + df.inputFiles()


def test_buckets(spark, tmp_path):
    root = str(tmp_path / "s")
    first = spark.createDataFrame([(i, f"k{i}") for i in range(200)], "n long, key string")
    change = Store(spark, root).change()
    change.write("t", first, "key", 16)
    one = change.commit()
    assert rows(one.read("t")) == rows(first) and one.version == 1
    touched = one.buckets_of("t", spark.createDataFrame([("k7",)], "key string"))
    assert len(touched) == 1 and "k7" in {r["key"] for r in one.read("t", touched).collect()}
    late = one.change()
    change = one.change()
    change.write("t", one.read("t", touched).where("key <> 'k7'"), "key", 16, touched)
    two = change.commit()
    assert rows(two.read("t")) == rows(first.where("key <> 'k7'")) and rows(one.read("t")) == rows(first)
    kept = folders(one) & folders(two)
    assert len(kept) == len(folders(one)) - 1  # only that bucket has a new folder
    late.write("t", first, "key", 16)
    with pytest.raises(Conflict):
        late.commit()
    change = two.change()
    change.write("t", first.limit(0), "key", 16, touched)  # a bucket may become empty
    three = change.commit()
    assert three.read("t", touched).count() == 0 and three.read("t").count() == 200 - one.read("t", touched).count()
    assert three.vacuum(1) >= 1 and Store(spark, root).versions() == [3] and rows(Store(spark, root).read("t")) == rows(three.read("t"))


def test_claims(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.folder.claim("_claims/00000001")  # a change that died before its version
    rows = spark.createDataFrame([(1,)], "key long")
    change = store.change()
    change.write("t", rows, "key", 2)
    with pytest.raises(Conflict):
        change.commit()
    store.abandon()
    assert change.commit().version == 1


def test_fulltext(spark, tmp_path):
    """Before and after updates, deletions and compaction: what an index of the live texts gives."""
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(words[(i * k) % 30] for k in range(1, 6)) + " common" for i in range(300)}
    store, name = Store(spark, str(tmp_path / "s")), "docs"
    queries = spark.createDataFrame([(q, f"w{q} W{(3 * q) % 30}, common") for q in range(12)] + [(99, "absent"), (98, "")], "query_id long, text string")
    terms = chunks.query_terms(queries, F.col("text"))

    def check(store, texts):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        own = FullText(store, name, ["doc_id"], 8)
        want = chunks.match_all(chunks.postings(docs, ["doc_id"], F.col("text")), terms, ["doc_id"])
        assert rows(own.match(terms)) == rows(want) and want.count() > 0
        freq = {r["term"]: r["n"] for r in own.frequencies(terms.select("term")).collect()}
        assert freq["common"] == len(texts) and "absent" not in freq

    def changed(store, gone, new):
        own, change = FullText(store, name, ["doc_id"], 8 + store.version), store.change()  # an index keeps the buckets it began with
        if gone:
            own.remove(change, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        if new:
            own.add(change, spark.createDataFrame(list(new.items()), "doc_id long, text string").repartition(3), F.col("text"))
        return change.commit()

    assert FullText(store, name, ["doc_id"], 8).match(terms).count() == 0
    store = changed(store, [], texts)
    check(store, texts)
    new = {i: f"w0 common w{i % 7}" for i in range(0, 300, 5)}
    store = changed(store, list(new), new)
    texts |= new
    check(store, texts)
    store = changed(store, [1, 2, 3], {})
    texts = {i: t for i, t in texts.items() if i not in (1, 2, 3)}
    check(store, texts)
    own, change = FullText(store, name, ["doc_id"], 8), store.change()
    own.compact(change)
    store = change.commit()
    check(store, texts)
    assert len(FullText(store, name, ["doc_id"]).state["segments"]) == 1
    posts = store.read("docs_posts_" + FullText(store, name, ["doc_id"]).state["segments"][0])
    assert posts.where("term = 'common'").agg(F.sum("n")).first()[0] == len(texts)
    one = spark.createDataFrame([(1, "common")], "query_id long, term string")
    read = FullText(store, name, ["doc_id"], 8)._posts(one).inputFiles()
    assert len({f.rsplit("bucket=", 1)[1].split("/")[0] for f in read}) == 1  # the bucket of the term alone
    assert not Store(spark, str(tmp_path / "s")).folder.names("_scratch")


def test_blocks(spark, tmp_path):
    """Units beyond a block are in blocks of their own, and a segment begins with one."""
    docs = spark.range(3 << BITS).select(F.col("id").alias("doc_id"), F.lit("all").alias("text"))
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        own, change = FullText(store, "d", ["doc_id"], 4), store.change()
        own.add(change, docs if not own.state["segments"] else docs.limit(5), F.col("text"))
        store = change.commit()
    posts = FullText(store, "d", ["doc_id"])._read("posts")
    assert posts.count() == 4 and posts.agg(F.max(F.size("units"))).first()[0] == 1 << BITS
    terms = spark.createDataFrame([(1, "all")], "query_id long, term string")
    assert FullText(store, "d", ["doc_id"]).match(terms).count() == (3 << BITS) + 5


def matches_full(spark, index, files, tmp_path, name):
    want = CodeIndex.build(spark, str(tmp_path / name), files, buckets=8)
    for table in TABLES:
        assert rows(index.store.read(table)) == rows(want.store.read(table)), table
    assert rows(index.edges) == rows(want.edges)
    queries = spark.createDataFrame([(1, "Engine"), (2, "estimate plan"), (3, "other"), (4, "fn run plan")], "query_id long, text string")
    terms = chunks.query_terms(queries, F.col("text"))
    for kind in ("symbols", "chunks"):
        assert rows(index.match(kind, terms)) == rows(want.match(kind, terms)), kind


def test_code_index(spark, tmp_path):
    files = fixtures.code_files(spark)
    root = str(tmp_path / "index")
    first = CodeIndex.build(spark, root, files, buckets=8)
    with pytest.raises(ValueError, match="version"):
        CodeIndex.build(spark, root, files)
    plain = api.index(files)
    assert rows(first.symbols) == rows(plain.symbols) and rows(first.edges) == rows(plain.edges) and rows(first.chunks) == rows(plain.chunks)
    assert rows(first.related("cost")) and {r["table"]: r["n"] for r in first.report().collect()}["files"] == files.count()
    opened = CodeIndex.open(spark, root)
    assert all(root in f for t in (opened.symbols, opened.edges, opened.chunks) for f in t.inputFiles())  # no text is read again

    moved = files.where("path <> 'src/plan.py'").withColumn("content", F.when(F.col("path") == "src/engine.rs", F.concat(F.lit("// first\n\tfn other() {\n}\n"), "content")).otherwise(F.col("content")))
    second, changes = opened.refresh(moved)
    assert {r["path"]: r["status"] for r in changes.collect()} == {"src/plan.py": "deleted", "src/engine.rs": "changed"}
    matches_full(spark, second, moved, tmp_path, "a")
    names = spark.createDataFrame([("src/plan.py",), ("src/engine.rs",)], "path string")
    touched = set(first.store.buckets_of("files", names))
    for table in TABLES:
        assert {b for b, f in second.store.tables[table].at.items() if first.store.tables[table].at.get(b) != f} <= touched
    again, none = second.refresh(moved)
    assert again.store.version == second.store.version and none.count() == 0
    assert rows(CodeIndex.open(spark, root, 1).symbols) == rows(plain.symbols)  # versions stay readable


def test_some_paths(spark, tmp_path):
    files = fixtures.code_files(spark)
    root = str(tmp_path / "index")
    first = CodeIndex.build(spark, root, files, buckets=8)
    edited = files.withColumn("content", F.concat("content", F.lit("\nfn tail() {}\n")))
    second, changes = first.refresh(edited, ["src/engine.rs", "gone.rs"])
    assert [tuple(r) for r in changes.collect()] == [("src/engine.rs", "changed")]
    third, changes = second.refresh(files.where("path <> 'web/view.ts'"), ["web/view.ts"])
    assert [tuple(r) for r in changes.collect()] == [("web/view.ts", "deleted")] and third.of_paths("symbols", ["web/view.ts"]).count() == 0
    fourth, changes = third.reindex(edited)
    assert {r["status"] for r in changes.collect()} == {"added", "changed"}
    matches_full(spark, fourth.compact(), edited, tmp_path, "b")
