"""An index derives all of its tables from one reading of the files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import code
from quarrylight.store.code_index import CodeIndex


def test_files_are_made_once(spark, tmp_path):
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(text):
        met.add(1)
        return text

    rows = [(f"a{i}.rs", f"fn f{i}() {{\n  g(1)\n}}\nfn g() {{\n  f{i}(2)\n}}") for i in range(20)]
    files = spark.createDataFrame(rows, "path string, text string").select("path", made("text").alias("content"))
    index = CodeIndex.build(spark, str(tmp_path / "store"), files, buckets=2)
    assert index.symbols.count() == 40 and index.store.read("references").count() == 40
    assert met.value <= 2 * len(rows)  # once to be judged, once to be kept
    assert index.store.folder.names("_scratch") == []


def test_called_names_are_not_multiplied(spark):
    text = "fn a() {\n" * 30 + "a(1);\n" * 40 + "fn b() {\n"
    own = spark.createDataFrame([("x.rs", text)], "path string, content string")
    got = [(r["line"], r["target_name"]) for r in code.called_names(own, code.symbols(own)).collect()]
    assert sorted(got) == [(i, "a") for i in range(1, 71)]  # 30 lines that declare it are called by name by the others
