"""A stored index that follows a folder between ticks, over restarts."""

from __future__ import annotations

import os
import time

from quarrylight.store.buckets import Store
from quarrylight.store.code_index import CodeIndex
from quarrylight.streaming.index import IndexLoop


def put(folder, name, text, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_ticks(spark, tmp_path):
    tree, root = tmp_path / "tree (1)", str(tmp_path / "store")
    put(tree, "src/a.rs", "fn a() {\n}\n", 100)
    put(tree, "target/x.rs", "fn x() {\n}\n", 100)
    make = lambda: IndexLoop(spark, str(tree), root, buckets=4)
    assert make().tick(1000) == [("src/a.rs", "added")]
    assert make().tick(1002) == []  # nothing changed, after a restart
    version = Store(spark, root).version
    put(tree, "src/b.py", "def b():\n    pass\n", 1003)
    assert make().tick(1004) == [] and Store(spark, root).version == version  # not quiet yet
    assert make().tick(1009) == [("src/b.py", "added")]
    put(tree, "src/a.rs", "fn a2() {\n}\n", 1010)
    (tree / "src/b.py").unlink()
    assert make().tick(1011) == [("src/b.py", "deleted")]
    assert make().tick(1016) == [("src/a.rs", "changed")] and make().tick(1018) == []
    put(tree, "src/a.rs", "fn a3() {\n}\n", 1010)  # same time and size: only a full pass sees it
    assert make().tick(1020) == [] and make().tick(1031) == [("src/a.rs", "changed")]
    assert [r["name"] for r in CodeIndex.open(spark, root).symbols.collect()] == ["a3"]


def test_stream(spark, tmp_path):
    tree, root = tmp_path / "tree", str(tmp_path / "store")
    put(tree, "a.rs", "fn a() {\n}\n", 100)
    loop = IndexLoop(spark, str(tree), root, quiet=0.0, full=1e9, buckets=2)

    def run(until):
        query = loop.start(str(tmp_path / "progress"), tick="1 second")
        try:
            deadline = time.time() + 120
            while time.time() < deadline and query.exception() is None and not until():
                time.sleep(0.5)
            assert query.exception() is None and until()
        finally:
            query.stop()

    def names():
        store = Store(spark, root)
        return {r["name"] for r in store.read("symbols").collect()} if "symbols" in store.tables else set()

    run(lambda: names() == {"a"})
    put(tree, "b.rs", "fn b() {\n}\n", 200)
    run(lambda: names() == {"a", "b"})  # a new start, the same progress
