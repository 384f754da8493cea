"""Learnings: short notes by category, kept in a Markdown list."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, trimmed

# Categories by the words of a task; the first group with a word in the task decides.
CATEGORIES = [
    ("build_test", ["test", "cargo test", "bench", "mock"]),
    ("arch", ["arch", "pattern", "layer", "module", "structure"]),
    ("gotcha", ["error", "bug", "fail", "panic", "fix"]),
    ("env", ["env", "path", "config", "setup"]),
    ("domain", ["domain", "logic", "business"]),
]


def task_category(task: Column) -> Column:
    """The category that a task asks for; null if none."""
    low, out = F.lower(task), F.lit(None).cast("string")
    for name, words in reversed(CATEGORIES):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), name).otherwise(out)
    return out


def for_category(learnings: DataFrame, task: str, limit: int) -> DataFrame:
    """Entries of the task's category, newest first."""
    own = learnings.where(F.col("category") == task_category(F.lit(task)))
    label = F.when(F.col("is_pinned"), F.concat(F.lit("PINNED:"), "category")).otherwise(F.col("category"))
    return own.orderBy(F.desc("ord")).limit(limit).select("ord", F.format_string("- [%s] %s", label, F.col("content")).alias("entry"))


_ASCII = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _key(item: dict) -> tuple[str, str]:
    return item["category"], item["content"].translate(_ASCII)


def _close(a, b) -> float:
    if a is None or b is None or len(a) != len(b):
        return 0.0
    x, y = np.asarray(a, float), np.asarray(b, float)
    norm = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float(x @ y) / norm if norm else 0.0


def _added(items: list[dict], new: dict, cap: int, look_back: int, threshold: float) -> list[dict]:
    """The list after one entry, which sees all that came before it."""
    new = new | {"content": (new["content"] or "").strip(SPACES), "category": (new["category"] or "").strip(SPACES) or "general", "is_pinned": bool(new["is_pinned"])}
    if not new["content"]:
        return items
    same = next((x for x in items if _key(x) == _key(new)), None)
    if same is None and "vector" in new:
        recent = [x for x in items[: -look_back - 1 : -1] if x["category"] == new["category"]]
        same = next((x for x in recent if _close(new["vector"], x["vector"]) >= threshold), None)
        if same is not None:
            same |= {k: v for k, v in new.items() if k not in ("ord", "category", "is_pinned")}
    if same is not None:
        same["is_pinned"] = same["is_pinned"] or new["is_pinned"]
        return items
    items = [*items, new | {"ord": max([new["ord"], *(x["ord"] + 1 for x in items[-1:])])}]
    over = sum(not x["is_pinned"] for x in items) - cap
    for _ in range(max(0, over)):
        items.remove(next(x for x in items if not x["is_pinned"]))
    return items


def add(learnings: DataFrame, new: DataFrame, *, cap: int = 30, look_back: int = 10, threshold: float = 0.92) -> DataFrame:
    """The list after new entries, one after another in order of ``ord``, each seeing those before it.

    An entry whose text is there in its category, in any case of A-Z, is not added. One that is
    close to one of the last ``look_back`` of all entries, of its category, the newest such, gives
    that its text. Either pins what it meets, if it is pinned. All others are added at the end,
    and transient entries beyond ``cap`` go, oldest first. Blank texts are ignored.

    Both: ord, category, content, is_pinned and, optionally, owner, which tells lists apart, and
    vector. A list is one file, which is added to in one task.
    """
    keys, names = _owner(learnings), learnings.columns

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["_new", "ord"], kind="stable").to_dict("records")
        items = [{k: r[k] for k in names} for r in rows if not r["_new"]]
        for r in rows:
            if r["_new"]:
                items = _added(items, {k: r[k] for k in names}, cap, look_back, threshold)
        return pd.DataFrame(items, columns=names)

    both = learnings.withColumn("_new", F.lit(0)).unionByName(new.select(names).withColumn("_new", F.lit(1)))
    return both.withColumn("_list", F.lit(0)).groupBy(*keys or ["_list"]).applyInPandas(fold, learnings.schema)


def _owner(rows: DataFrame) -> list[str]:
    return ["owner"] if "owner" in rows.columns else []


def parse(rows: DataFrame) -> DataFrame:
    """ord, category, content, is_pinned of Markdown lines (line_no, line): a header sets the category of the bullets below it.

    A column ``owner`` tells the lines of many lists apart, and stays; one list is one file.
    """
    keys = _owner(rows)
    header = F.when(F.col("line").rlike(r"^#+ "), trimmed(F.regexp_replace("line", r"^#+ ", "")))
    w = Window.partitionBy(*keys or [F.lit(0)]).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("head", F.last(header, True).over(w)).where(F.col("line").rlike(r"^\s*[-*] "))
    pinned = F.coalesce(F.upper("head").startswith("PINNED:"), F.lit(False))
    category = F.lower(F.coalesce(F.regexp_replace("head", "(?i)^PINNED:", ""), F.lit("general")))
    return own.select(*keys, F.col("line_no").cast("long").alias("ord"), trimmed(category).alias("category"), trimmed(F.regexp_replace("line", r"^\s*[-*] ", "")).alias("content"), pinned.alias("is_pinned"))


def render(learnings: DataFrame) -> DataFrame:
    """One text, or one for each ``owner``: pinned entries, then the others, a header where the category changes."""
    keys = _owner(learnings)
    order = Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc("is_pinned"), "ord")
    label = F.concat(F.when(F.col("is_pinned"), "PINNED:").otherwise(""), F.col("category"))
    own = learnings.withColumn("label", label).withColumn("before", F.lag("label").over(order)).withColumn("place", F.row_number().over(order))
    head = F.when(F.col("before").isNull() | (F.col("before") != F.col("label")), F.concat(F.lit("# "), "label", F.lit("\n"))).otherwise("")
    line = F.concat(head, F.lit("- "), F.col("content"))
    return own.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
