"""The registered queries on the smallest tables: columns, rows and results against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarrylight.llm import registry
from quarrylight.llm.tokenizers_io import BYTE_RANKS, rank_encoding, vocabulary

from .test_operators import components, shingle_set


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture
def rows(spark, sf_dir, request):
    return registry.QUERIES[request.param](spark, sf_dir).collect()


def of(name):
    return pytest.mark.parametrize("rows", [name], indirect=True)


@of("op1_language_model")
def test_op1(rows, texts):
    own = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    seen = Counter(w for i, ws in own.items() if not held[i] for w in ws)
    n, v = sum(seen.values()), len(seen)
    assert len(rows) == len(texts)
    for r in rows:
        ws = own[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(seen[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0


@of("op2_best_fit_packing")
def test_op2(rows, texts):
    tok, bins, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 1024))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] :][: r["length"]], "<u4").tobytes()) for r in own)
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024


@of("op3_jaccard_join")
def test_op3(rows, texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = components(sets)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(s), want[i]) for i, s in sets.items()}


@of("op6_byte_bpe")
def test_op6(rows, texts):
    enc = rank_encoding(vocabulary(BYTE_RANKS))
    ids = {i: enc.encode_ordinary(t) for i, t in texts.items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, x in ids.items()}


@of("op7_toxicity")
def test_op7(rows, texts):
    assert {(r["doc_id"], r["held_out"]) for r in rows} == {(i, zlib.crc32(str(i).encode()) % 3 == 1) for i in texts}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


@of("op8_permutation_index")
def test_op8(rows, spark, sf_dir):
    own = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    hits, wanted, found = 0, 0, defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float((own[r["query_id"]] * own[r["vec_id"]]).sum()), abs=1e-12)
    for q in (i for i in own if i % 20 == 0):
        best = sorted((i for i in own if i != q), key=lambda i: (-float((own[i] * own[q]).sum()), i))[:20]
        hits, wanted = hits + len(set(best) & set(found[q])), wanted + len(best)
    assert hits >= 0.9 * wanted


@of("op9_suffix_array_dedup")
def test_op9(rows, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    count = Counter(hash(t[k : k + 200]) for t in raw.values() for k in range(len(t) - 199))
    for r in rows:
        t = raw[r["doc_id"]]
        gone = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - 199):
            if count[hash(t[k : k + 200])] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), gone.sum(), (np.diff(np.r_[0, gone.astype(int)]) == 1).sum(), hashlib.sha256(kept).hexdigest())


@of("op10_token_counts")
def test_op10(rows, texts):
    enc = rank_encoding(vocabulary(BYTE_RANKS))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(enc.encode_ordinary(t)) for i, t in texts.items()}
    assert sum(r["n_chars_encoded"] for r in rows) < sum(r["n_chars_edited"] for r in rows)


def test_all_are_registered(spark, sf_dir):
    assert sorted(registry.QUERIES, key=lambda k: int(k[2:].split("_")[0])) == list(registry.QUERIES) and len(registry.QUERIES) == 13
    assert {"op4_exact_dedup", "op5_line_dedup", "op11_vector_codes", "op12_hard_negatives", "op13_quality_rules"} <= set(registry.SQL)
