"""The pipeline's near-dedup stage proposes by operator 4's Gray-order index, complete at its radius."""

import random

from sparkweave.llm import simhash, toxicity
from sparkweave.llm.common import Scratch
from tests.llm.test_operators import components


def test_index_edges_connect_all_near_fingerprints(spark):
    rng = random.Random(5)
    first = [rng.getrandbits(64) for _ in range(20)]
    first += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in first[:10]] + [first[0], first[0] ^ 7]
    rows = [(k, bytearray(x.to_bytes(8, "little") + rng.getrandbits(192).to_bytes(24, "little"))) for k, x in enumerate(first)]
    found = simhash.index_edges(spark.createDataFrame(rows, "rep long, bits binary"), 4, 2, Scratch(spark, "index")).collect()
    near = [(i, j) for i in range(len(first)) for j in range(i) if (first[i] ^ first[j]).bit_count() <= 2]
    places = range(len(first))
    assert components(places, [(r.u, r.v) for r in found]) == components(places, near)
    whole = [int.from_bytes(bits, "little") for _, bits in rows]
    assert found and all(r.differ == (whole[r.u] ^ whole[r.v]).bit_count() for r in found)


def test_stage_searches_the_index(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(simhash, "node_pairs", lambda *a, f=simhash.node_pairs: asked.append(a[1]) or f(*a))
    docs = spark.createDataFrame([(k, " ".join(f"w{k}{i}" for i in range(30))) for k in range(3)], "doc_id long, text string")
    assert simhash.similar_groups(docs).count() == 3 and asked == [2]


def test_toxicity_counts_slices(spark, monkeypatch):
    """Features are counted a slice at a time, over more tasks than shards; the model is the same however it is sliced."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(8)) + (" vile" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int")
    known, weights, intercept = toxicity.train(docs, labels)
    assert len(known)
    monkeypatch.setattr(toxicity, "COUNT_BYTES", 100)
    monkeypatch.setattr(toxicity, "COUNT_ROWS", 3)
    again = toxicity.train(docs, labels)
    assert known.tolist() == again[0].tolist() and weights.tolist() == again[1].tolist() and intercept == again[2]
