"""Operators for training data against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import inspect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarrylight.llm import blocks, bpe, exact_dedup, jaccard_join, language_model, line_dedup, packing, permutation_index, suffix_dedup, token_counts, toxicity
from quarrylight.llm.tokenizers_io import BYTE_JSON, BYTE_RANKS, json_coder, json_tokenizer, rank_coder, rank_encoding, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, body string"


def prose(rng, n: int, words: int = 400) -> str:
    return " ".join(f"w{i}" if i % 7 else f"W{i}." for i in rng.integers(0, words, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base, shared = prose(rng, 120), prose(rng, 60)
    near = base.split(" ")
    near[60] = "changed"
    long = prose(rng, 9000, 3000)
    own = [None, "", "", " \n\t", "one", base, base, " ".join(near), base + " tail", shared + "\n" + prose(rng, 80), prose(rng, 70) + "\n" + shared]
    own += ["line that is shared\nown\n\n  LINE that is shared\t", "x\n line that is shared", "short\nshort", "a  b \n\n c\t\td  ", "naïve café 中文字 <|endoftext|> 🙂" * 9, "ab" * 400, long, long + " more", "don't they're 123 4567"]
    return dict(enumerate(own))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, 1, "x") for i, t in texts.items()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact(spark, docs, texts, none):
    got = by_id(exact_dedup.exact_dedup(docs, fan=2))
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t or ""].append(i)
    for i, t in texts.items():
        own = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(own), len(own), i == max(own), hashlib.sha256((t or "").encode()).hexdigest())
    assert min(r["keep_id"] for r in exact_dedup.exact_dedup(docs, keep="smallest").where("group_size = 3").collect()) == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(twice).collect()
    assert sum(r["kept"] for r in rows) == 2 and {r["keep_id"] for r in rows if r["group_size"] == 3} == {1}
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_runs_merge_without_sorting(spark, monkeypatch):
    """Binomial rounds: merges of sorted runs only, and every round sends at most ``fan`` messages for a run."""
    rng = np.random.default_rng(0)
    keys = np.array([hashlib.sha256(bytes([i])).digest() + bytes(16) for i in rng.integers(0, 40, 300)], "S48")
    ids, rows = rng.integers(0, 90, 300), np.arange(300)
    parts = [exact_dedup.Run.of(keys[k::7], ids[k::7], rows[k::7], False) for k in range(7)]
    monkeypatch.setattr(np, "argsort", None)  # merging needs no sort of keys
    got = exact_dedup.Run.merge(parts, False)
    monkeypatch.undo()
    assert got.key.tolist() == sorted(set(keys.tolist()))
    for key, keep, row, count in zip(got.key.tolist(), got.keep, got.row, got.count, strict=True):
        own = [(ids[i], rows[i]) for i in range(300) if keys.tolist()[i] == key]
        assert (keep, row) == min(own) and count == len(own)
    assert got.dealt(11, 1, 4).num_rows <= 4 and all(t % 4 == 3 and t // 16 == 0 for t in got.dealt(11, 1, 4).column("run").to_pylist())
    df = spark.createDataFrame([(i, f"t{i % 50}", i) for i in range(400)], "doc_id long, text string, keep_id int").repartition(9)
    for fan in (2, 3, 16):
        out = exact_dedup.exact_dedup(df, keep="smallest", fan=fan).collect()
        assert all(r["keep_id"] == r["doc_id"] % 50 and r["group_size"] == 8 and r["kept"] == (r["doc_id"] < 50) for r in out) and len(out) == 400


def test_lines(spark, docs, texts, none):
    keys = {i: [line_dedup.line_key(x) for x in (t or "").encode().split(b"\n")] for i, t in texts.items()}
    holders = defaultdict(set)
    for i, own in keys.items():
        for k in own:
            if len(k.decode()) >= 10:
                holders[k].add(i)
    got = by_id(line_dedup.line_dedup(docs))
    for i, t in texts.items():
        rows = (t or "").encode().split(b"\n")
        stay = [x for x, k in zip(rows, keys[i], strict=True) if not (len(holders.get(k, ())) >= 2 and min(holders[k]) != i)]
        assert (got[i]["kept_text"].encode(), got[i]["n_lines"], got[i]["n_dropped"], got[i]["lang"]) == (b"\n".join(stay), len(rows), len(rows) - len(stay), "en")
    odd = spark.createDataFrame([(None, "the same long line"), (4, "the same long line"), (4, "the same long line\nb")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["kept_text"]) for r in line_dedup.line_dedup(odd).collect()) == [(0, ""), (4, "the same long line"), (4, "the same long line\nb")]
    assert line_dedup.line_dedup(none).count() == 0
    nulls = spark.createDataFrame([(None, "the same long line", 1, "a"), (None, "the same long line", 2, "b")], "doc_id long, text string, n_lines int, kept_text string")
    out = line_dedup.line_dedup(nulls)  # one document together: its own copies stay
    assert out.columns == ["doc_id", "kept_text", "n_lines", "n_dropped"] and {r["kept_text"] for r in out.collect()} == {"the same long line"}


def test_packing(docs, texts, none):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids, own = [*tok.encode(t or "", add_special_tokens=False).ids, 2], sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        assert sum(r["length"] for r in own) == len(ids) and (len(ids) <= 1024) == (len(own) == 1)
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        assert sum(r["length"] for r in own) <= 1024
    assert len(bins) == packing.BinCompletion(dict(Counter(r["length"] for r in rows)), 1024).bound(dict(Counter(r["length"] for r in rows)))
    assert packing.pack_documents(none).count() == 0


def test_bin_completion():
    counts = {6: 3, 5: 3, 4: 3, 3: 3, 2: 3}  # 60 in bins of 10
    solved = packing.BinCompletion(counts, 10).solve()
    used = Counter()
    for bag, times in solved:
        assert sum(bag) <= 10
        for s in bag:
            used[s] += times
    assert used == counts and sum(n for _, n in solved) == 6
    rng = np.random.default_rng(1)
    for _ in range(20):
        own = dict(Counter(rng.integers(1, 60, 40).tolist()))
        solver = packing.BinCompletion(own, 100)
        assert solver.bound(own) <= sum(n for _, n in solver.solve()) <= sum(n for _, n in solver.best_fit(own))


def components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(spark, docs, texts, none):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want, got = components(sets), by_id(jaccard_join.jaccard_components(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in texts}
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_large_groups(spark):
    """Buckets with many nodes: a leader for near copies, and pairs across components for those about a shared passage."""
    rng = np.random.default_rng(9)
    base, rows = prose(rng, 150).split(" "), {}
    for i in range(60):
        own = list(base)
        for k in rng.integers(0, 150, 1 + i % 3):
            own[k] = f"new{i}"
        rows[i] = " ".join(own)
    passage = prose(rng, 60)
    for i in range(60, 120):
        rows[i] = passage + " " + prose(np.random.default_rng(i // 2), 20 + i // 2 % 3) + (" x" if i % 2 else "")
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = by_id(jaccard_join.jaccard_components(df, buckets=8))
    assert {i: r["component_id"] for i, r in got.items()} == components({i: shingle_set(t) for i, t in rows.items()})


def test_jaccard_hot_segment_blocks_and_names(spark, monkeypatch):
    """One passage in many unlike documents, in blocks of members; sets of one name get others; awkward identifiers."""
    passage, rows = prose(np.random.default_rng(1), 30), {}
    for i in range(160):
        own = np.random.default_rng(i // 3)
        rows[i] = passage + " " + prose(own, 60) + (" x" * (i % 3))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    want = components({i: shingle_set(t) for i, t in rows.items()})
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    got = by_id(jaccard_join.jaccard_components(df, buckets=8))
    assert {i: r["component_id"] for i, r in got.items()} == want and len(set(want.values())) == 54
    text = " ".join(f"a{i}" for i in range(30))
    odd = [(None, text), (7, text + " z"), (7, "of its own"), (7, text), (9, text), (None, None), (11, "")]
    out = jaccard_join.jaccard_components(spark.createDataFrame([(*r, 1, "x") for r in odd], "doc_id long, text string, node int, bucket string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in out) == [(0, 0, 0), (0, 26, 0), (7, 1, 7), (7, 26, 7), (7, 27, 7), (9, 26, 7), (11, 0, 11)]
    tries, plain = [], jaccard_join._open_rows

    def colliding(batches):  # all sets share a name with another set
        for b in plain(batches):
            yield b.set_column(2, "node", pa.array([None if x is None else x % 3 for x in b.column("node").to_pylist()], pa.int64()))

    def rows_of(*a):
        tries.append(1)
        return colliding if len(tries) == 1 else plain

    monkeypatch.setattr(jaccard_join, "lean", lambda f: rows_of() if f is plain else f)
    assert {i: r["component_id"] for i, r in by_id(jaccard_join.jaccard_components(df, buckets=8)).items()} == want and len(tries) == 2


def test_signatures_lose_no_pair():
    schemes, rng = jaccard_join.Schemes(75, 100), np.random.default_rng(3)
    for _ in range(800):
        n = int(np.exp(rng.uniform(0, 6)))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        cut, add = rng.integers(0, n // 3 + 1, 2)
        y = np.unique(np.r_[rng.permutation(x)[cut:], rng.integers(0, 2**63, add).astype(np.uint64)])
        if len(y) and jaccard_join.similar(x, y, 75, 100):
            (kx, fx), (ky, fy) = schemes.signatures(x), schemes.signatures(y)
            a, b = defaultdict(int), defaultdict(int)
            for keys, flags, to in ((kx, fx, a), (ky, fy, b)):
                for k, f in zip(keys.tolist(), flags.tolist(), strict=True):
                    to[k] |= f
            assert any((a[k] | b[k]) == 3 for k in a.keys() & b.keys())
            px, py = (np.frombuffer(jaccard_join.sketch(s), np.uint8) for s in (x, y))
            assert jaccard_join.may_link(len(x), px, np.array([len(y)]), py[None, :], 75, 100)[0]


def test_suffix(docs, texts, none):
    raw, length = {i: (t or "").encode() for i, t in texts.items()}, 200
    count = Counter(t[i : i + length] for t in raw.values() for i in range(len(t) - length + 1))
    got = by_id(suffix_dedup.suffix_dedup(docs))
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept"]) == (len(t), gone.sum(), spans, kept)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_segments(monkeypatch):
    """Windows of a text in segments have the anchors that they have in one."""
    data = np.frombuffer(prose(np.random.default_rng(2), 900).encode(), np.uint8)
    whole = suffix_dedup.anchors(data, 200, 64)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 512)
    parts = suffix_dedup.anchors(data, 200, 64)

    def windows(found):
        return {s: a for _, a, first, last in zip(*found, strict=True) for s in range(first, last + 1)}

    assert windows(whole) == windows(parts)


def test_bpe(docs, texts, none):
    enc = rank_encoding(vocabulary(BYTE_RANKS))
    got = by_id(bpe.decode(bpe.encode(docs, block_bytes=3000, buckets=5)))
    for i, t in texts.items():
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == enc.encode_ordinary(t or "")
        assert got[i]["decoded"] == (t or "").encode()
    assert bpe.encode(none).count() == 0


def test_counts(spark, docs, texts, none):
    enc = rank_encoding(vocabulary(BYTE_RANKS))
    got = by_id(token_counts.token_counts(token_counts.planned_edits(docs)))
    for i, t in texts.items():
        t = t or ""
        n, e = len(t), "s\n" + t
        e = e[: n // 2] + " was revised" + e[n // 2 + 12 :]
        e = e[: n + 1000] + "\n-- s" + e[n + 1000 :]
        assert (got[i]["n_tokens"], got[i]["n_tokens_edited"], got[i]["n_chars_edited"]) == (len(enc.encode_ordinary(t)), len(enc.encode_ordinary(e)), len(e))
    assert got[17]["n_chars_encoded"] < 3000 < len(texts[17])
    assert token_counts.token_counts(none).count() == 0
    other = spark.createDataFrame([(None, "a b", "not edits"), (1, None, "x"), (1, "a b", None)], "doc_id long, text string, edits string")
    assert sorted((r["n_tokens"], r["n_tokens_edited"]) for r in token_counts.token_counts(other).collect()) == [(0, 0), (2, 2), (2, 2)]


ODD = ["a", "b", " ", "  ", "\n", "é", "'s", "1", ".", "word", " the", "\t", "中", "\u00a0", "\u3000", "\x1c", "\x85", "\u2003", "\x00", "\u200b", "<|endoftext|>", "🙂", "\r"]


def some(rng, n):
    return "".join(ODD[i] for i in rng.integers(0, len(ODD), n))


def test_stored_trees_random_edits():
    enc, rng = rank_encoding(vocabulary(BYTE_RANKS)).encode_ordinary, np.random.default_rng(8)
    for leaf in (3, 8, 256):
        for _ in range(25):
            texts = [some(rng, rng.integers(0, 60)) for _ in range(12)]
            trees, counts = token_counts.Builder(vocabulary(BYTE_RANKS), leaf).trees([t.encode() for t in texts])
            for text, body, n in zip(texts, trees, counts, strict=True):
                assert n == len(enc(text))
                for _ in range(4):
                    tree = token_counts.SegmentTree.load(body)
                    start, length, insert = int(rng.integers(0, 90)), int(rng.integers(0, 6)), some(rng, rng.integers(0, 4))
                    at = min(start, len(text))
                    text = text[:at] + insert + text[at + length :]
                    tree.edit(start, length, insert, enc)
                    assert (tree.text(), tree.tokens, tree.chars) == (text, len(enc(text)), len(text))
                    body = tree.store()


def test_later_edits_encode_only_their_region(spark):
    text = prose(np.random.default_rng(1), 20_000)
    trees = token_counts.build_trees(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    encode = rank_encoding(vocabulary(BYTE_RANKS)).encode_ordinary
    for place in (0, 50_000, len(text) // 3):
        edits = f"array(struct({place}L AS start, 5L AS length, 'new' AS insert))"
        trees = token_counts.apply_edits(trees.selectExpr("doc_id", "tree", f"{edits} AS edits"))
        text = text[:place] + "new" + text[place + 5 :]
        row = trees.first()
        assert row["n_tokens_edited"] == len(encode(text)) and row["n_chars_encoded"] < 2000


def test_pieces_and_words():
    """Cut as the tokenizers match, whatever white space, control characters and special strings there are."""
    rng, plain, ranks = np.random.default_rng(0), json_tokenizer(vocabulary(BYTE_JSON)), rank_encoding(vocabulary(BYTE_RANKS))
    for _ in range(60):
        texts = [some(rng, rng.integers(0, 14)) for _ in range(40)]
        raw = [t.encode() for t in texts]
        one, two = json_coder(vocabulary(BYTE_JSON)), rank_coder(vocabulary(BYTE_RANKS))
        for _ in range(2):  # the second time, from the block before
            a, b = one.ids(raw), two.ids(raw)
            assert [a[i].tolist() for i in range(40)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
            assert [b[i].tolist() for i in range(40)] == [ranks.encode_ordinary(t) for t in texts]
        words, values = blocks.Words(raw), blocks.Words(raw).values.to_pylist()
        ends = np.r_[0, np.cumsum(words.counts)]
        assert [[values[k] for k in words.index[x:y]] for x, y in zip(ends[:-1], ends[1:], strict=True)] == [t.lower().split() for t in raw]
    assert len(one.ids([])) == 0 and len(blocks.Words([b"", b""]).index) == 0
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "d" * 50, "e"]})
    assert [t for _, t in blocks.blocks(iter([batch]), 10)] == [[b"abc", b""], [b"d" * 50], [b"e"]]


def test_bpe_when_the_passes_differ(spark, texts, monkeypatch):
    """Words of another order than the positions': the block encodes them itself."""
    enc = rank_encoding(vocabulary(BYTE_RANKS))
    table = pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": list(texts.values()), "part": pa.array([0] * len(texts), pa.int32())})
    places = [b for b in bpe._send_places(4, 10**6)(iter([table]))]
    words = [b for b in bpe._send_words(4, 10**6)(iter([table.take(pa.array(range(len(texts) // 2)))]))]
    coded = []
    for k in range(4):
        own = pa.Table.from_batches(words).filter(pa.array([x == k for x in words[0].column("bucket").to_pylist()]))
        coded.append(bpe._encode_words(vocabulary(BYTE_RANKS))((pa.scalar(k),), own))
    out = bpe._reassemble(vocabulary(BYTE_RANKS), 4)((pa.scalar(0),), pa.concat_tables([*coded, pa.Table.from_batches(places)]))
    got = dict(zip(out.column("doc_id").to_pylist(), out.column("ids").to_pylist(), strict=True))
    assert all(np.frombuffer(got[i], "<u4").tolist() == enc.encode_ordinary(t or "") for i, t in texts.items())


def test_toxicity(spark, none):
    rng, insults, groups = np.random.default_rng(4), ["fool", "clod"], ["northers", "southers"]
    rows, labels = [], []
    for i in range(1500):
        kind = i % 4
        words = prose(rng, 40, 300).split(" ")
        if kind in (0, 1):
            words.append(insults[i % 2])
        if kind in (0, 2):
            words.append(groups[i // 2 % 2])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(kind == 0)))
    rows += [(5000, None, "en"), (5001, "", "en"), (None, "x", None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (0, 1, None), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id < 1500)]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(int(i)).encode()) % 3 == 1)).all()
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.97  # an additive model cannot: each word alone is as often clean
    assert toxicity.toxicity(none.select("doc_id", "text"), marks).count() == 0
    one = toxicity.toxicity(docs, marks.where("toxic = 0")).toPandas()
    assert (one.predicted == 0).all()


def test_toxicity_pairs_without_marginals():
    """The label is that exactly one of two words occurs: neither alone tells anything."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append([*([7] if a else []), *([11] if b else []), *(100 + rng.integers(0, 400, 12)).tolist()])
        labels.append(int(a != b))
    rows = [sorted(set(r)) for r in rows]
    model = toxicity.fit(rows[:2400], np.array(labels[:2400], float), 1024)
    own = [[model.slots[t] for t in r if t in model.slots] for r in rows[2400:]]
    assert {7, 11} <= set(model.slots) and len(model.slots) < 60
    assert np.mean([(model.score(r) >= 0.5) == y for r, y in zip(own, labels[2400:], strict=True)]) > 0.95


def test_toxicity_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(6)
    model = toxicity.FactorizationMachine(64, {i: i for i in range(20)}, 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    for _ in range(20):
        own = sorted(rng.choice(20, rng.integers(0, 9), replace=False).tolist())
        plain = 0.3 + sum(model.w[i] for i in own) + sum(model.v[i] @ model.v[j] for k, i in enumerate(own) for j in own[k + 1 :])
        assert model.score(own) == pytest.approx(1 / (1 + np.exp(-plain)))
    texts = [b"", b"word " * 50_000 + b"fool", b"Fool! fool"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 1, None], "text": [t.decode() for t in texts]})
    got = next(toxicity._score(model, 0.7)(iter([batch])))
    assert [0 <= x <= 1 for x in got.column("score").to_pylist()] == [True] * 3


def test_neighbours(spark, none):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[700:730] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0]), (2080, [None] * 24), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = permutation_index.permutation_search(df, shard_rows=400).toPandas()
    assert sorted(set(got.query_id)) == list(range(0, 1500, 20))
    hit, e = 0, x.astype(np.float64)
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        s = (e * e[q]).sum(axis=1)
        assert np.allclose(own.score, s[own.vec_id], atol=1e-12) and q not in set(own.vec_id) and own["rank"].tolist() == list(range(1, 21))
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        hit += len(set(best) & set(own.vec_id))
        if q == 40:
            assert own.vec_id.tolist() == list(range(700, 720))
    assert hit / (20 * 75) >= 0.9
    near = permutation_index.orders(e, e[:64], 16)
    block = permutation_index.Block(np.arange(1500), e, near, 64, 0.1, 10, 8)
    got, posted = block.candidates(near[3]), np.array([len(set(near[3][:8]) & set(v)) for v in near.tolist()])
    assert block.entries == posted.sum() < 1500 * 8 / 2 and len(got) == 150  # only the files of the query's pivots were read
    want = [sum(16 - max(near[3].tolist().index(p), v.index(p)) for p in near[3][:8].tolist() if p in v) for v in near.tolist()]
    assert set(got.tolist()) == set(sorted(range(1500), key=lambda i: (-want[i], i))[:150])
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows[:300]], "vec_id long, embedding array<float>, row int, kind string")
    assert permutation_index.permutation_search(wide, pivots=300, depth=280, reads=260).count() == 15 * 20
    few = permutation_index.permutation_search(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")).toPandas()
    assert len(few) == 4
    assert permutation_index.permutation_search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_model(spark, none):
    rng, rows = np.random.default_rng(7), []
    for i in range(240):
        words = [f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 60, 60)]
        rows.append((i, " ".join(words).title()))
    rows += [(900, None), (901, ""), (902, "never seen"), (None, "a1"), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shape = language_model.Shape(classes=4, words=4, tails=16, frequent=40)
    got = language_model.score_texts(df, shape=shape, train_every=1, train_lanes=16, rounds=2).toPandas()
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    seen = Counter(w for i, own in tokens if language_model.remainder(i, 7) != 2 for w in own)
    n, v = sum(seen.values()), len(seen)
    want = sorted((i is None, i or 0, len(own), sum(seen[w] > 0 for w in own), round(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in own), 6)) for i, own in tokens)
    have = sorted((r.doc_id != r.doc_id, 0 if r.doc_id != r.doc_id else int(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples())
    assert have == want and (got.train_tokens == n).all() and np.isfinite(got.score).all()
    held = got[got.held_out & (got.doc_id < 240)]
    assert held.score.sum() > held.base_score.sum() + 5  # the texts are of two kinds, which a state can tell apart
    assert language_model.score_texts(none, shape=shape).count() == 0


def test_language_model_is_a_distribution():
    shape = language_model.Shape(hidden=4, classes=3, words=2, tails=5, frequent=12)
    counts = {f"{'xyz'[i % 3]}{i}".encode(): 30 - i for i in range(20)} | {language_model.END: 9}
    mass = np.zeros(5)
    for w, c in counts.items():
        mass[language_model.tail_class(w, 5)] += c + 1
    words = language_model.Vocabulary.build(shape, sorted(counts.items(), key=lambda x: (x[0] != language_model.END, -x[1]))[:12], mass, sum(counts.values()), len(counts))
    model, h = language_model.Gated(shape, language_model.initial(words, mass)), np.random.default_rng(0).normal(size=(1, 4)).astype(np.float32)
    model.flat += np.random.default_rng(1).normal(0, 0.2, model.flat.shape).astype(np.float32)
    total = 0.0
    for c in range(3):
        total += sum(float(np.exp(model.log_probs(h, np.array([c]), np.array([p]))[0])) for p in range(2))
    for t in range(5):
        inner = sum((c + 1) for w, c in counts.items() if words.ids.get(w, 99) >= shape.heads and language_model.tail_class(w, 5) == t) + 1
        total += float(np.exp(model.log_probs(h, np.array([3 + t]), np.array([-1]))[0])) * inner / 10 ** words.tail_log[t]
    assert total == pytest.approx(1, abs=1e-5)


def test_gradient():
    shape = language_model.Shape(hidden=4, classes=3, words=2, tails=3)
    model, rng = language_model.Gated(shape), np.random.default_rng(1)
    x, fresh, cls = rng.integers(0, 9, (6, 5)), rng.random((6, 5)) < 0.2, rng.integers(0, 6, (6, 5))
    place, use, h = np.where(cls < 3, rng.integers(0, 2, (6, 5)), -1), rng.random((6, 5)) < 0.8, np.zeros((5, 4), np.float32)
    grad, _, _ = model.gradient(x, fresh, h, cls, place, use)

    def loss():
        own = np.flatnonzero(use.ravel())
        return -model.log_probs(model.forward(x, fresh, h)[0].reshape(-1, 4)[own], cls.ravel()[own], place.ravel()[own]).astype(np.float64).mean()

    for i in rng.choice(len(grad), 40, replace=False):
        keep = model.flat[i]
        model.flat[i] = keep + 1e-2
        up = loss()
        model.flat[i] = keep - 1e-2
        down = loss()
        model.flat[i] = keep
        assert (up - down) / 2e-2 == pytest.approx(grad[i], abs=2e-4)


def test_every_training_token_gives_a_gradient(monkeypatch):
    texts = [" ".join(f"w{(i * k) % 50}" for k in range(20 + i)) for i in range(90)]
    shape = language_model.Shape(classes=4, words=4, tails=16, frequent=40, window=8)
    counts = Counter(w for t in texts for w in [*t.encode().split(), language_model.END])
    mass = np.zeros(16)
    for w, c in counts.items():
        mass[language_model.tail_class(w, 16)] += c + 1
    words = language_model.Vocabulary.build(shape, list(counts.items()), mass, sum(counts.values()), len(counts))
    start, used = language_model.initial(words, mass), []
    gradient = language_model.Gated.gradient
    monkeypatch.setattr(language_model.Gated, "gradient", lambda self, *a: used.append(int(a[-1].sum())) or gradient(self, *a))
    every = inspect.signature(language_model.score_texts).parameters["train_every"].default
    train = sum(len(t.split()) + 1 for i, t in enumerate(texts) if language_model.remainder(i, 7) != 2)

    def seen(part, every):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(90)), "text": texts, "part": pa.array([part] * 90, pa.int32())})
        return [float(b.column("seen")[0].as_py()) for b in language_model._fit(words, start, every, 8, 0.03, 16)(iter([batch]))]

    assert seen(3, every) == [train] and sum(used) == train
    assert seen(1, 10**6) == []  # weights that no token has changed are not averaged


def test_lanes_are_bounded_by_tokens_and_blocks_deal_evenly(spark):
    """A text of a million words beside short ones; memory is that of the tokens, and scores are those of the text alone."""
    shape = language_model.Shape(hidden=4, classes=4, words=4, tails=16, frequent=40)
    rng = np.random.default_rng(2)
    long = np.r_[rng.integers(0, 20, 1_000_000), 0]
    short = [np.r_[rng.integers(0, 20, n), 0] for n in rng.integers(0, 40, 300)]
    words = language_model.Vocabulary.build(shape, [(b"\n", 301), *((b"w%d" % i, 99 - i) for i in range(20))], np.ones(16), 1000, 21)
    own = [short[0], long, *short[1:]]
    lanes = language_model.Lanes(np.concatenate(own), np.array(list(map(len, own))), 128, words)
    cells = sum(a.size for a, _ in lanes.windows(32))
    assert lanes.target.size == sum(map(len, own)) and cells < 1.2 * lanes.target.size + 128 * 32
    for i, ids in enumerate(own):
        assert (lanes.target[lanes.place[i] : lanes.place[i] + len(ids)] == ids).all() and lanes.fresh[lanes.place[i]]
    heads = [language_model.zlib.crc32(b"%d" % (part << 24 | k)) % 1024 for part in range(1000) for k in range(6)]
    assert len(set(heads)) > 900  # numbers of blocks share their low bits, their hashes do not


def test_tail_classes_of_arrays():
    words = [b"a", b"ab", b"abc", bytes([255, 0]), bytes([255]), b"b", b"ab"]
    for own in (words, words[:1], []):
        got = language_model.tail_classes(pa.array(own, pa.large_binary()), 64)
        assert got.tolist() == [language_model.tail_class(w, 64) for w in own]
    assert language_model.tail_classes(pa.array(words, pa.large_binary())[2:], 64).tolist() == [language_model.tail_class(w, 64) for w in words[2:]]


def test_scores_do_not_depend_on_neighbours(spark):
    """A long text scored among others and alone, and a table with a column of a clashing name."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"v{k}" for k in rng.integers(0, 50, n))) for i, n in enumerate([3000, 5, 80, 1, 900, 40])]
    shape = language_model.Shape(hidden=4, classes=4, words=4, tails=16, frequent=40)
    words = language_model.Vocabulary.build(shape, [(b"\n", 6), *((b"v%d" % i, 9) for i in range(30))], np.ones(16), 500, 31)
    weights = language_model.initial(words, np.ones(16))

    def heads(rows):
        batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "part": pa.array([0] * len(rows), pa.int32())})
        out = [p for b in language_model._score(words, weights, 4, 3)(iter([batch])) for p in map(language_model.unpack, b.column("body").to_pylist()) if len(p) == 7]
        return dict(zip(out[0][1].tolist(), out[0][3].tolist(), strict=True))

    together = heads(rows)
    for row in rows:
        assert heads([row])[row[0]] == pytest.approx(together[row[0]], rel=1e-5)
    clash = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, part int, bucket string")
    assert language_model.score_texts(clash, shape=shape).count() == 1


def test_bin_completion_of_many_lengths():
    counts = Counter()
    for x in np.clip(np.random.default_rng(3).lognormal(5.2, 0.8, 3000).astype(int), 1, None).tolist():
        counts[x % 512 or 512] += 1
        counts[512] += (x - 1) // 512
    counts = {s: n for s, n in counts.items() if n}
    solver = packing.BinCompletion(counts, 512)
    solved, used = solver.solve(), Counter()
    for bag, times in solved:
        assert sum(bag) <= 512
        for s in bag:
            used[s] += times
    assert used == counts and len(counts) == 487
    bins, greedy = sum(n for _, n in solved), sum(n for _, n in solver.best_fit(counts))
    assert solver.bound(counts) <= bins < greedy and solver.better >= 1 <= solver.leaves  # the search beats best fit
    assert solver.fillings({7: 10, 3: 1}, 45) == [(*[7] * 6, 3)]  # more than five pieces, until nothing fits
    assert len(packing.BinCompletion({1: 5000, 900: 2}, 1024).solve()) > 0


def test_best_fit_is_best_fit():
    """Against one piece at a time into the fullest bin with room."""
    rng = np.random.default_rng(11)
    for _ in range(40):
        counts = Counter(rng.integers(1, 40, rng.integers(1, 120)).tolist())
        rooms = []
        for s in sorted(counts.elements(), reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
            else:
                rooms.append(64 - s)
        solver, used = packing.BinCompletion(counts, 64), Counter()
        got = solver.best_fit(dict(counts))
        for bag, times in got:
            used.update({s: n * times for s, n in Counter(bag).items()})
        assert used == counts and Counter({r: n for r, n in Counter(rooms).items()}) == sum((Counter({64 - sum(bag): times}) for bag, times in got), Counter())
        assert solver.bound(dict(counts)) <= len(rooms)
