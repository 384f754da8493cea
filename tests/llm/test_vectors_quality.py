"""Vector codes, hard negatives and quality rules against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import hard_negatives, quality_rules, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, row long, code string, extra string"
NAN, INF = float("nan"), float("inf")


def vector_rows(rng, n=160, width=20, kinds=4):
    """Copies, ties, negative zeros, small differences, nulls and non-finite components, a null label, repeated and missing identifiers."""
    base = rng.normal(size=(12, width))
    rows = [(i, (base[rng.integers(12)] + rng.choice([0, 0.0002, 0.5]) * rng.normal(size=width)).astype("f4").tolist(), int(rng.integers(kinds))) for i in range(n)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(25)]  # copies
    rows += [(7, [0.0] * width, 0), (7, rows[3][1], 2), (100, rows[9][1], rows[9][2]), (None, rows[2][1], 1), (70, rows[1][1], None)]
    rows += [(2000, None, 1), (2001, [NAN] + [0.0] * (width - 1), 1), (2002, [None] + [0.0] * (width - 1), 1), (2003, [-INF] * width, 1), (2004, [1.0] * (width - 1), 1), (2005, [], 1)]
    return [(i, v, k, 5, "clash", "x") for i, v, k in rows]


def kept(rows, scale, width=20):
    return [(i, [int(np.floor(np.float64(x) * scale)) for x in v], k) for i, v, k, *_ in rows if v and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]


def plain_codes(rows, parts, entries, rounds, scale):
    own = kept(rows, scale)
    cuts = vector_codes.edges(20, parts)
    first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:z] for r in first] for a, z in cuts]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p, (a, z) in enumerate(cuts):
            groups = defaultdict(list)
            for _, v, _ in own:
                groups[near(v[a:z], books[p])].append(v[a:z])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else b for e, b in enumerate(books[p])]
    out, labels = [], Counter()
    for i, v, k in own:
        which = [near(v[a:z], books[p]) for p, (a, z) in enumerate(cuts)]
        error = sum(far(v[a:z], books[p][w]) for w, (p, (a, z)) in zip(which, enumerate(cuts), strict=True))
        labels[k] += error
        out.append((i, k, "".join(f"{w:02x}" for w in which), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error, labels[k], digest) for i, k, code, error in out), key=str)


@pytest.mark.parametrize("options", [(4, 16, 6, 4096), (3, 5, 2, 4096), (8, 256, 1, 3), (20, 2, 3, 1)])
def test_codes(spark, options):
    rows = vector_rows(np.random.default_rng(1))
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    parts, entries, rounds, scale = options
    got = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds, scale=scale)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect()), key=str) == plain_codes(rows, *options)


def test_codes_of_few_or_no_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(none).count() == 0 and vector_codes.compress(spark.createDataFrame([(1, None, 1, 1, "", "")], VECTORS)).count() == 0
    one = vector_codes.compress(spark.createDataFrame([(1, [0.5] * 8, None, 1, "", "")], VECTORS)).collect()
    assert [(r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in one] == [(1, None, "00" * 8, 0, 0)]
    with pytest.raises(ValueError, match="62 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1, 1, "", "")], VECTORS))


def test_intervals_leave_the_nearest(spark):
    """Entries so close that single precision cannot tell them apart, large components, exact ties, copies."""
    rng = np.random.default_rng(2)
    for size, step in ((100, 1), (1 << 20, 1), (1 << 27, 3), (1 << 27, 1 << 20)):
        x = rng.integers(-size, size, (400, 8))
        entries = x[:30] + rng.integers(-step, step + 1, (30, 8))
        entries = np.vstack([entries, entries[:5], x[3:4] + 1, x[3:4] - 1])
        which, looked = vector_codes.nearest(x, entries)
        exact = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (which == exact.argmin(axis=1)).all() and looked < exact.size / 2
    assert vector_codes.nearest(np.zeros((3, 0), np.int64), np.zeros((4, 0), np.int64))[0].tolist() == [0, 0, 0]


def plain_negatives(rows, every, positives, negatives, low, high, scale):
    own = [r for r in kept([r for r in rows if r[0] is not None and r[2] is not None], scale)]
    out = []
    for a, (i, v, k) in enumerate(own):
        if i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), j, b, m) for b, (j, w, m) in enumerate(own) if b != a), key=lambda s: s[:2])
        for s, j, _, _ in [x for x in scored if x[3] == k][:positives]:
            inside = [x for x in scored if x[3] != k and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(inside, 1)]
    return sorted(out)


def columns(r):
    return (r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])


@pytest.mark.parametrize(("scale", "shards"), [(256, {}), (7, {"shard_rows": 40, "shard_anchors": 3}), (1 << 20, {"shard_rows": 64})])
def test_negatives(spark, scale, shards):
    rows = vector_rows(np.random.default_rng(3), kinds=3)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = hard_negatives.hard_negatives(df, every=10, scale=scale, **shards)
    want = plain_negatives(rows, 10, 5, 10, 30, 90, scale)
    assert sorted(map(columns, got.collect())) == want and len(want) > 100


def test_negatives_of_few_or_no_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(none).count() == 0
    alone = spark.createDataFrame([(0, [1.0] * 8, 1, 1, "", "")], VECTORS)
    assert hard_negatives.hard_negatives(alone).count() == 0 and hard_negatives.hard_negatives(alone.withColumn("vec_id", F.lit(3))).count() == 0
    zero = spark.createDataFrame([(0, [0.0] * 8, 1, 1, "", ""), (1, [0.0] * 8, 1, 1, "", ""), (2, [0.0] * 8, 2, 1, "", "")], VECTORS)
    assert [columns(r) for r in hard_negatives.hard_negatives(zero).collect()] == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError, match="62 bits"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e9] * 8, 1, 1, "", "")], VECTORS))


def test_merging_shards(spark):
    rows = spark.createDataFrame([(1, s, s % 7, s) for s in range(500)], "anchor long, shard int, score int, row long")
    got = hard_negatives._best(rows, ["anchor"], [F.desc("score"), "row"], 3, 500, fan=8)
    assert [(r["rank"], r["row"]) for r in got.orderBy("rank").collect()] == [(1, 6), (2, 13), (3, 20)]


def test_slices_and_intervals():
    rng = np.random.default_rng(4)
    for width, size in ((1, 3), (64, 120), (70, 1 << 20)):
        v = rng.integers(-size, size, (90, width))
        planes = int(np.abs(v).max()).bit_length() + 1
        sliced, exact = hard_negatives.slices(v, planes), v @ v[0]
        anchor = hard_negatives.Anchor(sliced[0])
        seen = []
        at, score, _ = anchor.narrowed(sliced, np.arange(90), lambda low, high: seen.append((low, high)) or np.ones(90, bool))
        assert (score == exact).all() and (at == np.arange(90)).all()
        widths = [int((high - low).max()) for low, high in seen]
        assert all((low <= exact).all() and (exact <= high).all() for low, high in seen) and widths == sorted(widths, reverse=True) and widths[-1] == 0
        best, score, work = anchor.narrowed(sliced, np.arange(90), hard_negatives.nearest_ones(5))
        assert set(np.argsort(-exact, kind="stable")[:5]) <= set(best)
        assert width == 1 or work < 90 * planes  # candidates were dropped before the last plane


DOCS = "doc_id long, text string, lang string, source string, kept string, level int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_counts(text):
    w, text = words_of(text), text or ""
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines), sum("A" <= c <= "Z" for c in text))


def awkward_docs():
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 7))) for _ in range(n))
    texts = [None, "", " \n\t\x0b\x0c\r ", "one", "a b c a b c", "x x x x x", "a b a b a b a", "lines\nlines\n lines\nlines ", "\r\nA\r\nA\r\n", "naïve é  中文 🙂 Ab#*$%&|<>", "tab\tin\x0bword\x1cx", "a b c\nd a b c", "word" * 5000, prose(3000)]
    rows = [(i, t, "en", "s1") for i, t in enumerate(texts)]
    rows += [(100 + i, prose(80 + i) + "\n" + prose(10), "en", "hot") for i in range(90)]
    rows += [(300, prose(80).upper(), "en", "hot"), (301, " ".join(f"{w}###" for w in prose(90).split()), "en", "hot"), (302, "\n".join([prose(30)] + [prose(20)] * 1 + ["same line here"] * 40), "en", "hot"), (303, " ".join(w * 4 for w in prose(100).split()), "en", "hot")]
    rows += [(400 + i, prose(70), None if i % 2 else "de", None) for i in range(12)] + [(100, prose(90), "en", "hot"), (None, prose(90), "en", "rare")]
    return [(i, t, lang, source, "clash", 9) for i, t, lang, source in rows]


def test_measures(spark):
    rows = awkward_docs()
    got = quality_rules.measured(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r["_doc"]["text"], *(r[c] for c in quality_rules.COUNTS)) for r in got) == Counter((r[1], *plain_counts(r[1])) for r in rows)


def plain_verdicts(rows, reach=3, least=30):
    measures = []
    for _, text, lang, source, *_ in rows:
        c = dict(zip(quality_rules.COUNTS, plain_counts(text), strict=True))
        measures.append((lang, source, c, {r.name: c[r.part] * r.scale // c[r.whole] for r in quality_rules.RULES} if c["n_words"] else {}))
    leading = lambda x: x >> max(0, x.bit_length() - quality_rules.BITS) << max(0, x.bit_length() - quality_rules.BITS)
    values = defaultdict(list)
    for lang, source, _, m in measures:
        for name, x in m.items():
            for key in ((0, lang, source), (1, lang), (2,)):
                values[key, name].append(leading(x))
    out = []
    for lang, source, c, m in measures:
        failed, base = [], c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        for r in quality_rules.RULES:
            if not m:
                continue
            own = next((v for key in ((0, lang, source), (1, lang), (2,)) if len(v := sorted(values[key, r.name])) >= least), None) or sorted(values[(2,), r.name])
            q1, q3 = own[-(-len(own) // 4) - 1], own[-(-3 * len(own) // 4) - 1]
            far = reach * max(q3 - q1, r.width)
            if m[r.name] > q3 + far or (r.low and m[r.name] < q1 - far):
                failed.append(r.name)
        out.append((base, ",".join(failed), not base and not failed))
    return out


def test_quality_rules(spark):
    rows = awkward_docs()
    got = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS).repartition(3))
    want = Counter((r[0], *plain_counts(r[1]), *v) for r, v in zip(rows, plain_verdicts(rows), strict=True))
    assert Counter((r["doc_id"], *(r[c] for c in quality_rules.COUNTS), r["base_failed"], r["failed_rules"], r["kept"]) for r in got.collect()) == want
    fails = {r["doc_id"]: r["failed_rules"] for r in got.collect()}
    assert "capital_share" in fails[300] and "symbol_share" in fails[301] and "dup_line_share" in fails[302] and "word_length" in fails[303]
    assert sum(k[-1] for k in want for _ in range(want[k])) >= 90  # prose of its source's kind stays
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_filter(spark):
    rows = awkward_docs()
    df = spark.createDataFrame(rows, DOCS)
    got = quality_rules.quality_filter(df)
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == Counter(r for r, v in zip(rows, plain_verdicts(rows), strict=True) if v[2])
    assert quality_rules.quality_filter(df.limit(0)).count() == 0 and quality_rules.quality_rules(df.limit(0)).count() == 0
    empty = quality_rules.quality_rules(df.where("doc_id < 3")).collect()
    assert {(r["n_words"], r["base_failed"], r["kept"], r["failed_rules"]) for r in empty} == {(0, True, False, "")}


def test_sketches_merge(spark):
    """Sketches of parts add up to the sketch of all, and quartiles are as close as the buckets are fine."""
    rng = np.random.default_rng(6)
    counts = spark.createDataFrame([(f"l{i % 3}", f"s{i % 7}", int(n), int(n * rng.integers(2, 40)), 0, 0, 0, 1, 0) for i, n in enumerate(rng.integers(1, 5000, 4000))], "lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    both = quality_rules.merged(quality_rules.sketches(counts.where("n_words < 2000")).unionByName(quality_rules.sketches(counts.where("n_words >= 2000"))))
    whole = quality_rules.merged(quality_rules.sketches(counts))
    add = lambda df: {tuple(r)[:-1]: r["n"] for r in df.groupBy("level", "lang", "source", "rule", "bucket").agg(F.sum("n").alias("n")).collect()}
    assert add(both) == add(whole)
    exact = sorted(r[0] for r in counts.select(quality_rules.measure(quality_rules.RULES[0])).collect())
    got = quality_rules.quartiles(whole).where("level = 2 AND rule = 'word_length'").first()
    for value, q in ((got["q1"], 0.25), (got["q3"], 0.75)):
        true = exact[int(np.ceil(q * len(exact))) - 1]
        assert true * (1 - 2.0 ** (1 - quality_rules.BITS)) <= value <= true
