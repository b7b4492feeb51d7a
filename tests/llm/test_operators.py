"""The training-data operators against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparkweave.llm import bpe, debruijn, hmm, mixing, near_vectors, simhash, suffix_array, token_counts, toxicity, va_search, windows

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
#: Columns that operators must not trip over.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version int, spans string, token string, taken int, score double"


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(n)) for n in (120, 300, 80, 60, 200)]
    long = base[1].split(" ")
    near = long[:150] + ["changed"] + long[151:]
    out = [*base, " ".join(near), base[0], base[2] + " " + base[2], "x\n" + base[3][:250] + " É日本 " + base[4], None, "", " \t\n", "one", "two words", "Aa " * 400, "é" * 300, base[4].upper(), "lone  double \n spaces"]
    return out + [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 97, t, "en", f"s{i % 4}" if i % 7 else None, len(t or ""), 1, "x", "y", 2, 0.5) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[1]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def lowered(text):
    return text.encode().lower()


def test_bpe_equals_the_library(docs):
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d, *(hashlib.sha256(x).hexdigest() for x in (",".join(map(str, library.encode_ordinary(t))).encode(), t.encode()))) for d, t in rows_of(docs))
    got = bpe.round_trip(docs, PATH, PATTERN).collect()
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got) == want
    ids = bpe.encode_documents(docs, PATH, PATTERN)
    decoded = {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(ids, PATH, PATTERN).collect()}
    assert all(decoded[d] == t.encode() for d, t in rows_of(docs))


def test_bpe_on_odd_strings():
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, rng = bpe.Encoder(ranks, PATTERN), random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("aab  \n\t\r\x1c\x85\xa0'sS　é漢12½!?.,​😀tl") for _ in range(rng.randint(0, 40)))
        assert own.encode(text) == library.encode_ordinary(text), repr(text)


def test_token_counts(docs):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    lengths = [len(library.encode_ordinary(t)) for _, t in rows_of(docs)]
    summed = token_counts.token_counts(docs, PATH, PATTERN)
    for r in summed.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert r.docs_up_to == sum(x <= r.n_tokens for x in lengths)
    for r in token_counts.at_limits(summed, [1, 7, 50, 10**6]).collect():
        assert r.truncated_tokens == sum(min(x, r.limit) for x in lengths) and r.docs_fit == sum(x <= r.limit for x in lengths)


def test_substring_dedup(docs):
    found = sorted(rows_of(docs))
    starts = {}
    for d, t in found:
        w = words_of(t)
        for i in range(len(w) - 49):
            starts.setdefault(tuple(w[i : i + 50]), set()).add(d)
    want = []
    for d, t in found:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - 49):
            if min(starts[tuple(w[i : i + 50])]) < d:
                gone |= set(range(i, i + 50))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert sum(x[2] for x in want) > 100
    got = debruijn.digests(debruijn.without_earlier(docs)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("group_rows", [20_000, 1])
def test_suffix_array(docs, group_rows, monkeypatch):
    monkeypatch.setattr(windows, "GROUP_ROWS", group_rows)
    found = [(d, t.encode()) for d, t in rows_of(docs)]
    counts = Counter(r[i : i + 200] for _, r in found for i in range(len(r) - 199))
    want = []
    for d, r in found:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if counts[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((d, len(r), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(r, gone) if not g)).hexdigest()))
    assert sum(x[2] for x in want) > 1000
    got = suffix_array.digests(suffix_array.without_repeats(docs)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def components(ids, links):
    label = {i: i for i in ids}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_simhash(docs):
    def fp(text):
        w = lowered(text).split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    found = [(d, fp(t)) for d, t in rows_of(docs)]
    label = components([d for d, _ in found], [(a, b) for a, x in found for b, y in found if (x ^ y).bit_count() <= 2])
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{x:016x}", label[d]) for d, x in found)


def test_simhash_index_finds_every_link(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(900)]
    near = [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base[:300]]
    fps = [int(np.uint64(x).astype(np.int64)) for x in dict.fromkeys(base + near)]
    hashed = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long").withColumn("more", F.lit(b"").cast("binary"))
    from sparkweave.llm.common import Scratch

    got = {r.doc_id: r.component_id for r in simhash.groups(hashed, 2, Scratch(spark, "test")).collect()}
    x = np.array(fps, np.int64).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)
    assert got == components(range(len(fps)), list(zip(i.tolist(), j.tolist())))


def test_similar_groups(spark):
    rng = random.Random(8)
    rows = []
    for k in range(30):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[:150] + ["new"] + w[151:])), (10 * k + 2, " ".join(w[::-1]))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * k] == got[10 * k + 1] == 10 * k and got[10 * k + 2] == 10 * k + 2 for k in range(30))


@pytest.mark.parametrize("dense", [0, 5, 10**6])
def test_bucket_links_connect_what_all_pairs_connect(dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (12, 4)).astype(np.uint64)
    lanes = base[rng.integers(0, 12, 200)] ^ (np.uint64(1) << rng.integers(0, 60, (200, 4)).astype(np.uint64))
    group, side = np.sort(rng.integers(0, 9, 200)), rng.integers(1, 3, 200)
    side[group < 5] = 0
    u, v, differ = simhash.bucket_links(group, side, lanes, 7)
    bits = np.bitwise_count(lanes[:, None] ^ lanes[None, :]).sum(2)
    apart = (side[:, None] == 0) | (side[:, None] != side[None, :])
    want = np.argwhere(np.triu((group[:, None] == group[None, :]) & apart & (bits <= 7), 1)).tolist()
    assert (bits[u, v] == differ).all() and {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist())} <= {tuple(x) for x in want}
    assert components(range(200), list(zip(u.tolist(), v.tolist()))) == components(range(200), want) != {i: i for i in range(200)}


def test_proposals_find_links_at_the_threshold(spark, monkeypatch):
    """Recall over planted pairs at a similarity of 0.80 to 0.82, small blocks included."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(31)
    new = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows = []
    for k in range(1200):
        w = new(220)
        other = w[:196] + new(24)  # 192 of 240 shingles in common
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(1200)) >= 0.97 * 1200
    assert all(c // 2 == d // 2 for d, c in got.items())


@pytest.mark.parametrize("tile", [128, 6])
def test_similar_groups_in_a_template(spark, tile, monkeypatch):
    """Texts that share a template hang together by proposals that fail the exact check; their real near copies are found."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(21)
    new = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    template, rows = new(300), []
    for k in range(40):
        own = template[:240] + new(60)
        rows += [(3 * k, " ".join(own))]
        rows += [(3 * k + c, " ".join(own[: 270 - 4 * c] + new(26) + own[296 - 4 * c :])) for c in (1, 2)]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(list(sets), links)
    assert 30 < len(set(want.values())) < len(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_similar_groups_of_repeats(spark):
    """Texts with the same shingles are copies however often they repeat a line."""
    rng = random.Random(9)
    w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(314)]
    line = w[300:]
    rows = [(n, " ".join(w[:300] + line * n)) for n in (2, 10, 20, 40)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: 2 for n, _ in rows}


def test_similar_groups_of_filler(spark):
    """Texts that share a filler and nothing else are no copies, and rows of one id are told apart by their texts."""
    rng = random.Random(10)
    new = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    filler = " x" * 500
    one = new(100)
    rows = [(1, new(100) + filler), (2, one + filler), (3, new(100) + filler), (4, one + " " + filler), (5, new(100)), (5, one), (6, None), (7, " ")]
    got = sorted((r.doc_id, r.component_id) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 2), (5, 2), (5, 5), (6, 6), (7, 6)]


def test_language_model(docs):
    found = [(d, lowered(t).split(), zlib.crc32(str(d).encode()) % 10 == 0) for d, t in rows_of(docs)]
    counts = Counter(w for _, words, held in found if not held for w in words)
    texts_ = sum(not held for *_, held in found)
    n, v = sum(counts.values()) + texts_, len(counts) + 1
    want = {}
    for d, words, held in found:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words) + math.log10((texts_ + 0.1) / (n + 0.1 * (v + 1)))
        want[d] = (held, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n, base)
    got = hmm.score_texts(docs).collect()
    assert len(got) == len(found)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4]) and r.score < 0


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(1)
    model = hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(hmm.CLASSES), hmm.STATES).T)
    lengths = np.array([3, 1, 5])
    classes = rng.integers(0, hmm.CLASSES, lengths.sum()).astype(np.int16)
    got, at = hmm.forward(model, classes, lengths), 0
    for k, n in enumerate(lengths):
        alpha = model.start * model.emit[classes[at]]
        for c in classes[at + 1 : at + n]:
            alpha = alpha @ model.move * model.emit[c]
        assert got[k] == pytest.approx(math.log(alpha.sum()))
        at += n


def test_expected_counts_cross_segments():
    rng = np.random.default_rng(2)
    model = hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(hmm.CLASSES), hmm.STATES).T)
    lengths = np.array([1, 64, 65, 66, 300])
    classes = rng.integers(0, hmm.CLASSES, lengths.sum()).astype(np.int16)
    total = hmm.expected_counts(model, classes, lengths, np.arange(len(lengths)))
    moves = hmm.STATES + hmm.STATES**2
    assert total[: hmm.STATES].sum() == pytest.approx(len(lengths))
    assert total[hmm.STATES : moves].sum() == pytest.approx(lengths.sum() - len(lengths))
    assert total[moves:].reshape(hmm.CLASSES, hmm.STATES).sum(1) == pytest.approx(np.bincount(classes, minlength=hmm.CLASSES))


def test_expected_counts_are_those_of_whole_sequences(monkeypatch):
    """Against a plain forward-backward pass, with sequences cut into many segments; likelihood rises."""
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 50)
    rng = np.random.default_rng(5)
    model = hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES) * 0.3, hmm.STATES), rng.dirichlet(np.ones(hmm.CLASSES), hmm.STATES).T)
    lengths = np.array([1, 7, 8, 9, 15, 40, 2])
    classes, chosen = rng.integers(0, 30, lengths.sum()).astype(np.int16), np.array([0, 1, 2, 3, 4, 5])
    want, at = np.zeros(hmm.STATES + hmm.STATES**2 + hmm.CLASSES * hmm.STATES), 0
    for n in lengths[:6]:
        c = classes[at : at + n]
        f, g = [model.start * model.emit[c[0]]], [np.ones(hmm.STATES)]
        for x in c[1:]:
            f.append(f[-1] @ model.move * model.emit[x])
        for x in c[:0:-1]:
            g.insert(0, model.move @ (model.emit[x] * g[0]))
        p = f[-1].sum()
        gamma = [a * b / p for a, b in zip(f, g)]
        want[: hmm.STATES] += gamma[0]
        for t in range(n - 1):
            want[hmm.STATES : hmm.STATES + hmm.STATES**2] += (f[t][:, None] * model.move * (model.emit[c[t + 1]] * g[t + 1])[None, :] / p).ravel()
        for x, w in zip(c, gamma):
            want[hmm.STATES + hmm.STATES**2 + x * hmm.STATES :][: hmm.STATES] += w
        at += n
    assert np.allclose(hmm.expected_counts(model, classes, lengths, chosen), want)
    shares, before = np.full(hmm.CLASSES, 1e-9), -np.inf
    for _ in range(5):
        now = hmm.forward(model, classes, lengths).sum()
        assert now > before
        total, before = hmm.expected_counts(model, classes, lengths, np.arange(7)), now
        moves = hmm.STATES + hmm.STATES**2
        emit = total[moves:].reshape(hmm.CLASSES, hmm.STATES) + shares[:, None]
        move = total[hmm.STATES : moves].reshape(hmm.STATES, hmm.STATES)
        model = hmm.Model(total[: hmm.STATES] / total[: hmm.STATES].sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_every_round_reads_every_training_text(spark, monkeypatch):
    rng, one_round, rounds = random.Random(12), hmm.baum_welch, []

    def watched(classed, model, shares, *more):
        after, total = one_round(classed, model, shares, *more), 0
        for row in classed.select("held", "lengths", "classes").collect():
            total = total + hmm.expected_counts(model, hmm._values(row.classes, np.int16), np.array(row.lengths, np.int64), np.flatnonzero(~np.array(row.held)))
        moves = hmm.STATES + hmm.STATES**2
        want = hmm.Model.of(total[: hmm.STATES], total[hmm.STATES : moves].reshape(hmm.STATES, hmm.STATES), total[moves:].reshape(hmm.CLASSES, hmm.STATES), shares)
        rounds.append(np.allclose(after.move, want.move) and np.allclose(after.emit, want.emit))
        return after

    monkeypatch.setattr(hmm, "baum_welch", watched)
    rows = [(i, " ".join(rng.choice(("la", "de", "ein", "und", "the")) for _ in range(rng.randint(1, 9)))) for i in range(5000)]
    assert hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    assert len(rounds) == 8 and all(rounds)


def test_mixing(docs):
    got = mixing.mix(docs).withColumn("n", F.lit(1)).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert sum({r.source_size: r.target for r in got}.values()) <= sum(r["size"] for r in got) + 1e-6
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), f"s{rng.randrange(5)}") for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).join(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id")
    by = got.groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("s"), F.sum("taken").alias("taken")).collect()
    weights = {f"s{i}": (5, 2, 1)[i % 3] for i in range(5)}
    total = sum(r.s for r in by)
    assert sum(r.target for r in by) == pytest.approx(total)
    free = [r for r in by if r.target < 3 * r.s - 1e-6]
    assert len({round(r.target / weights[r.source], 6) for r in free}) == 1
    assert all(abs(r.taken - r.target) <= 60 for r in by)


def test_mixing_solves_the_dual(spark):
    """Rates are exponential tilts cut at 3 that meet the targets; multipliers by bisection."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 40), f"s{i % 3}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, named=True).collect()
    for source in ("s0", "s1", "s2"):
        own = [r for r in found if r.src == source]
        sizes, mean = np.array([r["size"] for r in own]), own[0].source_size / len(own)
        low, high = -60.0, 60.0
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (lam, high) if (sizes * np.minimum(3, np.exp(lam * sizes / mean))).sum() < own[0].target else (low, lam)
        assert np.allclose([r.rate for r in own], np.minimum(3, np.exp(lam * sizes / mean)), atol=1e-4)


def test_mixing_with_a_long_text(spark):
    """Half a very long text is more than any correction of single copies; the small texts take it up."""
    rng = random.Random(4)
    rows = [(0, "w " * 50_000, "a"), *((i, "w " * 10, "a") for i in range(1, 10_001))]
    rows += [(20_000 + i, "w " * rng.randint(1, 60), "b") for i in range(3000)] + [(30_000, "w " * 30_001, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((5.0, 3.0), (2.0, 5.0)):
        by = mixing.mix(docs, weights).groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.min("copies").alias("low"), F.max("copies").alias("high")).collect()
        assert len(by) == 2 and all(abs(r.taken - r.target) <= 10 and 0 <= r.low and r.high <= 3 for r in by)


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [(i, [float(np.float32(y)) for y in x], i % 3) for i, x in enumerate(base)]
    rows += [(100 + i, [float(np.float32(y)) for y in base[i] + 0.1 * rng.standard_normal(16)], i % 3) for i in range(40)]
    rows += [(200, rows[0][1], 0), (201, None, 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [None] * 16, 1), (205, rows[5][1], None), (206, [float("inf")] + [1.0] * 15, 2), (207, [1.0, 2.0], 0), (208, [], 0), (150, rows[3][1], 0), (150, rows[3][1], 0)]
    return spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, rep string, dim int")


def test_near_vectors(spark):
    df = vectors(spark)
    found = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    good = [k for k, (_, e, label) in enumerate(found) if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = []
    for a in good:
        for b in good:
            x, y = np.array(found[a][1]), np.array(found[b][1])
            if a != b and found[a][2] == found[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((a, b))
    label = components([v for v, *_ in found], [(found[a][0], found[b][0]) for a, b in links])
    n = Counter(a for a, _ in links)
    want = sorted((v, n[k], label[v]) for k, (v, *_) in enumerate(found))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_vectors(df).collect()) == want


def test_near_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 8)
    rng = np.random.default_rng(6)
    x = (np.ones(12) + 0.08 * rng.standard_normal((90, 12))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = ((u @ u.T >= 0.93).sum(1) - 1).tolist()
    got = near_vectors.near_vectors(df).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == want and {r.component_id for r in got} == {0}


def test_near_vectors_of_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0, 0.01]), (None, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.01]), (1, None), (4, [0.0, 1.0, 0.02])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, label int")
    got = near_vectors.near_vectors(df).collect()
    text = lambda rows: sorted(map(str, rows))
    want = [(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 2, 4, False), (None, 2, 4, False), (1, 0, 1, True), (4, 2, 4, True)]
    assert text(tuple(r) for r in got) == text(want)


def test_near_vectors_recall_at_the_threshold(spark):
    rng = np.random.default_rng(12)
    a = rng.standard_normal((3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.94, (3000, 1))
    pairs = cosine * a + np.sqrt(1 - cosine**2) * b
    rows = [(2 * i + k, [float(y) for y in x], 0) for i in range(3000) for k, x in enumerate((a[i], pairs[i]))]
    got = {r.vec_id: r.component_id for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(3000)) >= 0.998 * 3000


def test_va_search(spark):
    df = vectors(spark)
    found = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in df.collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = []
    for q, v in found:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in found if c != q and len(w) == len(v))[:5]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(scores, 1)]
    got = va_search.search(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_toxicity_learns_held_out_documents(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["Nasty", "vile,", "GROSS"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, " ")]
    labels += [(7, 1, None), (99999, 0, 1), (1, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for result in (
        bpe.round_trip(empty, PATH, PATTERN),
        token_counts.token_counts(empty, PATH, PATTERN),
        debruijn.without_earlier(empty),
        suffix_array.without_repeats(empty),
        simhash.near_duplicates(empty),
        hmm.score_texts(empty),
        mixing.mix(empty),
        toxicity.toxicity(empty, labels),
        near_vectors.near_vectors(none),
        va_search.search(none, F.col("vec_id") % 50 == 0),
    ):
        assert result.count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(0, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            after.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
            before = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        else:
            assert after.count() == before.count()


def test_pipeline_stages_on_edge_cases(spark, docs, empty, tmp_path):
    """Without labels nothing goes as toxic; near-dedup equals brute force, rows of one id told apart; empty tables stay empty."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    sets = []
    for _, text in rows:
        w = lowered(text).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = components(range(len(rows)), links)
    best = {}
    for i, row in enumerate(rows):
        best.setdefault(label[i], []).append(row)
    kept = [(r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    assert sorted(d for d, _ in kept) == sorted(min(d for d, _ in group) for group in best.values()) and set(kept) <= set(rows)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, str(tmp_path)).count() == 0
