"""Operators 11 to 13 against brute force on small tables, with their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkweave.llm import centroid_blocks as blocks
from sparkweave.llm import chat_format as chats
from sparkweave.llm import collocations as phrases


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                mine = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == n]
                if mine:
                    centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = [sum(d for d, m in found if m == n) for n in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i or 0), n, d, inertia[n], sum(inertia), sha[n]) for (i, _), (d, n) in zip(kept, found, strict=True))


def test_clusters_equal_brute_force_with_bad_rows_and_copies(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] + draw.normal(size=6) * 0.05).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000, rows[0][1])] * 200 + [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 5 + [float("nan")]), (2004, [1.0] * 5 + [float("inf")]), (2005, [1.0] * 5 + [None]), (None, [0.5] * 6), (2006, [0.0] * 6), (2007, [5000.0] * 6)]
    table = spark.createDataFrame([Row(vec_id=i, embedding=v, cluster=7, key="x", v=1) for i, v in rows], "vec_id long, embedding array<float>, cluster int, key string, v int").repartition(3)
    got = blocks.cluster(table, k=5, rounds=4, dims=6).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), *r[1:]) for r in got) == brute_clusters(rows, 5, 4, 6)


def test_fewer_vectors_than_centroids_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert blocks.cluster(spark.createDataFrame([], schema), dims=2).collect() == []
    got = blocks.cluster(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], schema), dims=2).collect()
    assert {(r.vec_id, r.distance) for r in got} == {(1, 0), (2, 0)} and len({r.cluster for r in got}) == 2
    with pytest.raises(Exception, match="too large"):
        blocks.cluster(spark.createDataFrame([(1, [1.0, 200_000.0])], schema), dims=2).collect()


def test_hilbert_keys_walk_to_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = [k.tobytes() for k in blocks.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walked = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(walked, axis=0)).sum(1) == 1).all()


def test_boxes_never_lose_the_nearest_and_both_number_types_agree():
    draw = np.random.default_rng(9)
    x = draw.integers(-1000, 1000, (40, 3)) + np.repeat(draw.integers(-5, 5, (4, 3)) * 2000, 10, 0)
    boxes = x.reshape(4, 10, 3)
    centroids = draw.integers(-9000, 9000, (8, 3))
    exact = ((x[:, None] - centroids) ** 2).sum(2)
    for shift in (0, blocks.IN_DOUBLES):  # far from the origin whole numbers are compared as such
        best, distance = blocks.nearest(x + shift, boxes.min(1) + shift, boxes.max(1) + shift, np.full(4, 10), centroids + shift)
        assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert blocks.candidates(boxes.min(1), boxes.max(1), centroids).mean() < 0.9


def brute_chats(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_chats_read_back_whatever_they_hold(spark):
    draw = random.Random(3)
    pieces = [*chats.CONTROL, "\\", "<", "[", "s>", "INST]", "/", "\n", "é𝒳", "ok ", "<\\s>", "[\\\\INST]"]
    text = lambda: "".join(draw.choice(pieces) for _ in range(draw.randrange(12)))
    rows = [(conv, turn, draw.choice(["user", "assistant", "system", None, "</s>[INST]"]), text()) for conv in range(40) for turn in range(draw.randrange(1, 7))]
    rows += [(50, 1, "assistant", None), (50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (50, None, "user", "last"), (None, 0, "user", "no id"), (60, 0, "assistant", "x<s>" * 300_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash")).withColumn("parts", chats.text_parts(F.col("text")))
    turns = chats.format_chats(table)
    got = {r.conv_id: r for r in chats.digests(turns).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == brute_chats(rows)
    stored = turns.collect()
    for conv, r in got.items():
        whole = "".join(t.formatted for t in sorted((t for t in stored if t.conv_id == conv), key=lambda t: t.place))
        assert len(whole) == r.formatted_chars
        # The markers stand only where the template put them.
        assert all(whole.count(mark) == r.n_turns for mark in (chats.BEGIN, chats.SAYS, chats.SAID, chats.END)) and "<image>" not in whole
        for t in stored:
            if t.conv_id == conv:
                assert whole[t.begin : t.begin + len(t.formatted)] == t.formatted
                assert t.loss_begin is None or whole[: t.loss_begin].endswith(chats.SAYS) and whole[t.loss_end :].startswith(chats.SAID)
    assert chats.digests(chats.in_order(turns.repartition(7))).count() == len(got)
    assert chats.digests(chats.format_chats(table.limit(0))).collect() == []


def test_parts_become_placeholders_in_order(spark):
    part = lambda kind, text=None, ref=None, amount=None: (kind, text, ref, amount)
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", None, "a.png", 1569.0), part("text", " and <image>"), part("audio", "x", "b.wav", 1.0), part("document", None, "c.pdf", 2.0)]),
        (1, 1, "assistant", [part("image", None, None, None), part("odd", "kept"), part(None, "!")]),
        (2, 0, "user", []),
        (3, 0, "user", None),
        (4, 0, "user", [part("audio", None, "n", float("nan")), part("audio", None, "m", -3.0)]),
    ]
    table = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chats.PARTS}")
    got = {(r.conv_id, r.place): r for r in chats.format_chats(table).collect()}
    first, second = got[1, 0], got[1, 1]
    assert first.formatted == "<s>user[INST]see <image> and <\\image><audio><document>[/INST]</s>"
    assert [tuple(a) for a in first.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 25), ("document", "c.pdf", 1152)] and first.tokens == 1180
    assert chats.read_turn(second.formatted) == ("assistant", "<image>kept!") and second.begin == len(first.formatted)
    assert got[2, 0].formatted == got[3, 0].formatted == "<s>user[INST][/INST]</s>" and got[3, 0].attachments == [] and got[4, 0].tokens == 2


def brute_phrases(rows, least, limit):
    totals, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + n])) for n in range(1, 6) for i in range(len(words) - n + 1))
    out = {}
    frequent = {key: c for key, c in f.items() if c >= least}
    absorbed = {(lang, w[i:j]) for (lang, w), c in frequent.items() for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w) and frequent[lang, w[i:j]] == c}
    for (lang, w), a in frequent.items():
        if len(w) > 1 and (lang, w) not in absorbed:
            score, _, left, right = min((1000 * a * totals[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:limit], 1))


def test_phrases_equal_brute_force(spark):
    draw = random.Random(8)
    words = ["a", "b", "C", "dé", "ÉE", "x y", "a", "a", "the", "of", "\x01"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b", "; "]) for _ in range(draw.randrange(60)))
    rows = [(draw.choice(["en", "en", "fr", None, "und"]), text()) for _ in range(150)] + [("en", None), ("en", ""), (None, None), ("de", "new york times now. " * 30), ("solo", "one two")] + [("en", "same text, same text")] * 20
    table = spark.createDataFrame([(lang, text, 1, 2, "p") for lang, text in rows], "lang string, text string, n int, rank int, phrase string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(table, 5, 40).collect())
    assert got == brute_phrases(rows, 5, 40)
    assert phrases.collocations(table.limit(0), 5, 40).collect() == []


def test_a_text_above_the_step_is_cut_without_losing_or_doubling(spark):
    text = "new York times are here now " * 200_000  # 5.6 MB without an end of a piece
    assert len(text) > phrases.STEP
    got = {r.phrase: r.f for r in phrases.frequent_phrases(spark.createDataFrame([("en", text)], "lang string, text string"), 100)[0].collect()}
    assert got["new york times are here"] == 200_000 and got["now new york times are"] == 199_999 and got["new"] == 200_000
    parts = list(phrases._parts(np.frombuffer(text.encode(), np.uint8)))
    assert len(parts) == 12 and sum(own for _, own in parts) == len(text)


def test_no_table_of_phrases_has_wide_rows(spark, monkeypatch):
    widths, kept = [], phrases.Scratch.table

    def table(self, df):
        out = kept(self, df)
        widths.append(max((len(v) for r in out.collect() for v in r if isinstance(v, (str, bytes, bytearray))), default=0))
        return out

    monkeypatch.setattr(phrases.Scratch, "table", table)
    docs = spark.createDataFrame([("en", f"new york times {i} are here " * 40) for i in range(300)], "lang string, text string").coalesce(1)
    assert phrases.collocations(docs, 50, 10).count() > 0
    assert len(widths) > 4 and max(widths) < 100


def test_one_word_above_the_step(spark):
    rows = [("en", "x" * 9_000_000 + " a b"), ("en", "a b " * 5)]
    assert [(r.phrase, r.a) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 6, 9).collect()] == [("a b", 6)]


def test_collisions_are_told_apart():
    raw = np.frombuffer(b"aa bb aa bb cc", np.uint8)
    hashes, begins, ends = phrases.tokenised(raw)
    same = np.full(len(hashes), 7, np.uint64)  # every word with one hash
    ids = phrases._word_ids(raw, same, begins, ends)
    assert ids[0] == ids[2] != ids[1] == ids[3] and len(set(ids)) == 3
    firsts, counts = phrases._groups(ids, np.arange(4), np.full(4, 5, np.uint64), 2)  # every pair with one fingerprint
    assert sorted(zip(phrases._spelt(raw, begins[firsts], ends[firsts + 1]).to_pylist(), counts, strict=True)) == [(b"aa bb", 2), (b"bb aa", 1), (b"bb cc", 1)]


def test_bits_hold_every_fingerprint(spark):
    prints = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    table = phrases.bit_tables(spark.createDataFrame([(2, int(p)) for p in prints], "n int, print long"), range(1, 3))
    assert phrases.has_bit(table[2].value, prints.view(np.uint64)).all() and not phrases.has_bit(table[1].value, prints.view(np.uint64)).any()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000).view(np.uint64)
    assert phrases.has_bit(table[2].value, others).mean() < 0.1
