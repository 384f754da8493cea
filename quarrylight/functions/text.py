"""Scalar functions on text, numbers and times; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the full-text query language reserves.
RESERVED = ["and", "or", "not", "near"]

# Images that are badges.
BADGES = r"!\[.*?\]\(https://img\.shields\.io/.*?\)|!\[.*?\]\(https://badge.*?\)\s*"

# Names of workflow stages, and what may stand for each.
STAGES = [
    ("Context", ["context"]),
    ("Plan", ["plan"]),
    ("Ask_Revise", ["ask_revise", "ask", "revise", "ask/revise"]),
    ("Build", ["build"]),
    ("Test_Recheck", ["test_recheck", "test", "recheck", "test/recheck"]),
    ("Fix", ["fix"]),
    ("Proposal", ["proposal", "document", "review", "proposal/review"]),
]

# Phrases that count as an approval.
APPROVALS = [
    "ok", "proceed", "approved", "approve", "start", "go ahead", "do it", "làm đi", "đồng ý", "chấp nhận", "yes", "yep", "lgtm",
    "looks good", "agree", "let's do it", "make the change", "exec", "triển khai", "tiến hành", "duyệt", "thực thi", "chốt", "ok bro", "được đấy",
]


#: Every character that counts as white space.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(SPACES))


def bytes_of(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def token_estimate(text: Column, code: bool = False) -> Column:
    """Tokens of a text by its bytes: four to a token, 2.8 in code; null is none."""
    return F.coalesce(F.ceil(bytes_of(text) / F.lit(2.8 if code else 4.0)), F.lit(0)).cast("long")


def lines_of(text: Column) -> Column:
    """Lines without their ends, which are line feeds after at most one carriage return; a text that ends with one has no empty line after it."""
    whole = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(whole)


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def sanitize_query(query: Column) -> Column:
    """Words of a query in quotes: letters, digits and underscores, without reserved words."""
    clean = F.regexp_replace(query, r"[^\p{L}\p{N}_\s]", "")
    words = F.filter(F.split(clean, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(RESERVED))
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")


def collapse_blank_lines(text: Column) -> Column:
    """Lines without white space at their ends; of blank lines in a row one stays."""
    lines = F.transform(lines_of(text), lambda x: F.regexp_replace(x, r"\s+$", ""))
    pairs = F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit("x")), lines).alias("before"))
    kept = F.filter(pairs, lambda p: p["line"].isNotNull() & ~((p["line"] == "") & (p["before"] == "")))
    return F.array_join(F.transform(kept, lambda p: p["line"]), "\n")


def strip_markup_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def compress(text: Column) -> Column:
    """Without comments and badge images, lines trimmed at their ends, of blank lines in a row one."""
    return collapse_blank_lines(F.regexp_replace(strip_markup_comments(text), BADGES, ""))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[ _]", "-"), r"[^\p{L}\p{N}-]", "")


def frontmatter_name(text: Column) -> Column:
    """Value of the first line that starts with ``name:``; null if there is none."""
    found = F.regexp_extract(text, r"(?m)^name:[ \t]*[\"']?(.*?)[\"']?[ \t]*\r?$", 1)
    return F.when(found != "", found)


def content_hash(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def day_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def hour_label(ts: Column) -> Column:
    return F.date_format(F.date_trunc("hour", ts), "HH:00")


def saved_percent(original: Column, optimized: Column) -> Column:
    """Share saved, in percent to one decimal; 0 where there was nothing to save."""
    return F.when(original > 0, F.round(100.0 * (original - optimized) / original, 1)).otherwise(F.lit(0.0))


def risk_level(dependents: Column) -> Column:
    return F.when(dependents > 8, "High").when(dependents >= 3, "Medium").otherwise("Low")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def file_uri_path(uri: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(uri, r"^file://", ""), "%20", " ")


def age_text(seconds: Column) -> Column:
    """Age in seconds, minutes, hours or days, rounded down."""
    s = F.floor(seconds)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
    )


def token_text(n: Column) -> Column:
    return F.when(n >= 1000, F.format_string("%.1fk", n / 1000.0)).otherwise(n.cast("long").cast("string"))


def percent_text(x: Column) -> Column:
    return F.format_string("%.1f%%", x.cast("double"))


def duration_text(ms: Column) -> Column:
    return F.when(ms >= 1000, F.format_string("%.1fs", ms / 1000.0)).otherwise(F.concat(ms.cast("long").cast("string"), F.lit("ms")))


def savings_badge(percent: Column) -> Column:
    return F.when(percent > 50, "green").when(percent > 20, "plain").otherwise("red")


def linear_scale(value: Column, top: Column, y0: float, y_max: float) -> Column:
    """A value of [0, top] as a place between ``y_max`` and ``y0``; ``y_max`` if there is no range."""
    return F.lit(y_max) - F.when(F.coalesce(top, F.lit(0)) != 0, value / top * (y_max - y0)).otherwise(0.0)


def slot_center(place: Column, n: Column, x0: float, width: float) -> Column:
    """The middle of slot ``place``, from 0, of ``n`` slots."""
    return F.lit(x0) + width / n * place + width / n / 2


def column_width(n: Column, width: float, least: float = 4.0) -> Column:
    return F.greatest(F.lit(least), width / n * 0.5)


def field_maximum(*fields: str) -> Column:
    """The largest value of any field in any row, as an aggregate; nulls count as 0, as does an empty table."""
    return F.coalesce(F.greatest(F.lit(0), *(F.max(F.coalesce(F.col(f), F.lit(0))) for f in fields)), F.lit(0))


def is_approval(message: Column) -> Column:
    text = F.lower(trimmed(message))
    return F.exists(F.array(*map(F.lit, APPROVALS)), lambda p: F.contains(text, p))


def expand_query(task: Column, focus: Column, phase: Column) -> Column:
    """The task, its focus unless general, and the words that its phase adds."""
    f = trimmed(focus)
    query = F.when(f.isNotNull() & (f != "") & (f != "general"), F.concat(task, F.lit(" "), f)).otherwise(task)
    low = F.lower(query)
    return (
        F.when((phase == "test") & ~F.contains(low, F.lit("test")), F.concat(query, F.lit(" test testing unit mock")))
        .when((phase == "debug") & ~F.contains(low, F.lit("debug")), F.concat(query, F.lit(" debug error recovery exception")))
        .when((phase == "plan") & ~F.contains(low, F.lit("plan")), F.concat(query, F.lit(" architecture standards modular design")))
        .otherwise(query)
    )


def stage_name(raw: Column) -> Column:
    """The stage that a word stands for, in any case; null if it stands for none."""
    asked, name = F.lower(trimmed(raw)), F.lit(None).cast("string")
    for stage, words in STAGES:
        name = F.when(asked.isin(words), stage).otherwise(name)
    return name


def matches_filter(needle: str, *fields: str) -> Column:
    """Whether any field contains the text, in any case."""
    hit = F.lit(False)
    for name in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(name).cast("string")), F.lit(needle.lower())), F.lit(False))
    return hit


def extension(path: Column) -> Column:
    return F.element_at(F.split(F.lower(path), r"\."), -1)


def symbol_passage(kind: Column, path: Column, signature: Column, name: Column) -> Column:
    """The text that stands for a symbol in vector search; its name stands in for a signature that is null."""
    return F.format_string("%s in %s — %s", kind, path, F.coalesce(signature, name))


def chunk_passage(path: Column, start: Column, end: Column, text: Column) -> Column:
    """The text that stands for a chunk in vector search."""
    return F.format_string("code in %s lines %d-%d: %s", path, start, end, clip(text, 512))


def prefixed(text: Column, kind: str | None = None) -> Column:
    """A text as embedding models expect it: of kind "query" or "passage", or as it is."""
    return F.concat(F.lit(f"{kind}: "), text) if kind in ("query", "passage") else text


def catalog_hash(order: Column, *fields: Column) -> Column:
    """A fingerprint of a catalog in order, as an aggregate: a hash over the rows' hashes, eight bytes for each row."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("at"), F.xxhash64(*fields).alias("hash"))))
    return F.hex(F.xxhash64(F.transform(rows, lambda r: r["hash"])))
