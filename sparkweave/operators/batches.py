"""Cutting, scores and searches of whole sequences, a batch of Arrow rows at a time.

What segment, edges and candidates define as expressions in a row is computed here over all sequences of a batch
together. Numbers are whole millionths (scores) and billionths (log probabilities), so sums need no settling. A matrix
of pairs is held for a tile of sequences only, and for none of more than MATRIX fragments: there a fragment's line is
scored when the search stands on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = 26

#: Cells of a tile, and fragments of a sequence up to which its matrix is held.
TILE, MATRIX = 1 << 19, 512

#: Above every cost, and what a proved pair is worth, in millionths.
NEVER, PROVED = 1 << 61, 1_000_000_000

#: What a search of one setting gives (see found), and what may be added to it.
FOUND = "path:array<int>,forced:int,fell_back:boolean,placed:int,realised:int,unproved:int,total:bigint"
MADE = "made:string"
MEASURES = ("exact_match", "similarity", "edit_similarity", "apa", "lcr", "tau")

EDGES = "array<struct<i:int,j:int>>"


def _text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and the places where each begins and the last ends."""
    array = array.cast(pa.large_string())
    at = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _lists(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins and the last ends, and all that is in them; a null is an empty list."""
    at = np.concatenate(([0], np.cumsum(array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return at, array.flatten()


def _list_array(at: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... sizes[k] of them, for all k in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


# Cutting


def _site_draws(ids: list[int], counts: np.ndarray, at: np.ndarray, replicas: int, seed: int) -> np.ndarray:
    """The first 32 bits of each site's digest, a line for each replica (segment.draw)."""
    names = [b"%d" % p for p in at.tolist()]
    ends = np.cumsum(counts).tolist()
    digests = []
    for replica in range(replicas):
        begin = 0
        for i, end in zip(ids, ends):
            if end > begin:
                prefix = b"%d|%d|%d|" % (seed, i, replica)
                digests += [md5(prefix + name).digest() for name in names[begin:end]]
            begin = end
    bits = np.frombuffer(b"".join(digests), ">u4")[::4] if digests else np.zeros(0, np.uint32)
    return bits.reshape(replicas, len(names))


def _proved(pieces: list[list[str]]) -> list[tuple[int, int]]:
    """edges.edges_of the replicas of one sequence."""
    last = {x: k for k, x in enumerate(pieces[0])}
    sizes = {len(x): None for x in last}
    found = []
    for w in dict.fromkeys(x for replica in pieces for x in replica):
        for size in sizes:
            if size < len(w):
                i = last.get(w[:size])
                if i is not None:
                    j = last.get(w[size:])
                    if j is not None:
                        found.append((i, j))
    return found


def cut_and_proved(ratio: float = 0.3, replicas: int = 3, seed: int = 42) -> Callable[[Column | str, Column | str], Column]:
    """A function of seq_id and seq: struct of primary (fragments of replica 0 by the first rule) and edges (what all
    replicas prove), as segment.cut_rows and edges.edges_of have them."""
    low, high = (np.uint64(min(int(min(p, 1.0) * 2**32), 2**32)) for p in (float(ratio), ratio * 1.5))

    def cut(ids: pa.Array, texts: pa.Array) -> pa.Array:
        buffer, off = _text(texts)
        n = len(texts)
        ends = np.zeros(len(buffer) + 1, bool)
        ends[off[1:]] = True
        before = np.flatnonzero(((buffer[:-1] == 75) | (buffer[:-1] == 82)) & (buffer[1:] != 80) & ~ends[1:-1]) if len(buffer) > 1 else np.zeros(0, np.int64)
        cuts = before + 1
        owner = np.searchsorted(off, before, "right") - 1
        draws = _site_draws(ids.to_pylist(), np.bincount(owner, minlength=n)[:n], cuts - off[owner], replicas, seed)
        kept = draws.astype(np.uint64) > np.where(buffer[before] == 75, high, low)
        starts, lists = [], []
        for line in kept:
            begins = np.sort(np.concatenate((off[:-1][np.diff(off) > 0], cuts[line])))
            starts.append(begins)
            lists.append(np.searchsorted(begins, off))
        letters = buffer.tobytes().decode("latin-1")
        pieces = [[letters[b:e] for b, e in zip(s, s[1:])] for s in ([*begins.tolist(), len(letters)] for begins in starts)]
        edges, counts = [], np.zeros(n + 1, np.int64)
        bounds = [at.tolist() for at in lists]
        for k in range(n):
            if bounds[0][k + 1] - bounds[0][k] > 1:
                proved = _proved([p[at[k] : at[k + 1]] for p, at in zip(pieces, bounds)])
                edges += proved
                counts[k + 1] = len(proved)
        flat = np.array(edges, np.int32).reshape(-1, 2)
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["i", "j"])
        begins = np.append(starts[0], len(buffer)).astype(np.int32)
        fragments = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(np.ascontiguousarray(buffer)))
        return pa.StructArray.from_arrays([_list_array(lists[0], fragments), _list_array(np.cumsum(counts), pairs)], ["primary", "edges"])

    return F.arrow_udf(cut, f"struct<primary:array<string>,edges:{EDGES}>")


# Scores


def log_billionths(model: DataFrame, backoff: Column) -> tuple[np.ndarray, int]:
    """The log probabilities of all grams of three letters in billionths, the back-off where the model has none, and that.

    At most LETTERS ** 3 rows, whatever the corpus; they pass through the driver.
    """
    back = model.sparkSession.range(1).select(backoff).first()[0]
    table = np.full(LETTERS**3, round(back * 1e9), np.int64)
    for context, residue, logp in model.filter("context rlike '^[A-Z]{2}$' and residue rlike '^[A-Z]$'").select("context", "residue", "logp").collect():
        x, y, z = (ord(c) - 65 for c in context + residue)
        table[(x * LETTERS + y) * LETTERS + z] = round(logp * 1e9)
    return table, round(back * 1e9)


class Fragments:
    """The fragments of a batch and what scores need of them; fragment k of sequence s is number at[s] + k."""

    def __init__(self, primary: pa.Array, edges: pa.Array, table: np.ndarray, back: int, windows: Sequence[int]):
        self.table, self.back, self.windows = table, back, list(windows)
        self.at, pieces = _lists(primary)
        self.n = np.diff(self.at)
        buffer, off = _text(pieces)
        self.text, self.off = buffer, off
        code = buffer.astype(np.int64) - 65
        self.size, first, last = np.diff(off), off[:-1], off[1:] - 1
        self.first = code[first]
        many = self.size > 1
        self.second = np.where(many, code[np.minimum(first + 1, last)], 0)
        self.last = code[last]
        self.before = np.where(many, code[np.maximum(last - 1, first)], -1)
        self.bad_end, self.bad_start = ~np.isin(buffer[last], (75, 82)), buffer[first] == 80
        self.leads = buffer[first] == 77
        # Of a pair's targets only the first two depend on both fragments; the others are summed once for each fragment.
        grams = np.zeros(len(code), np.int64)
        grams[2:] = table[(code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:]]
        inner = [np.zeros(len(self.size), np.int64)] * 3
        for p in range(2, max(windows)):
            inner.append(inner[-1] + np.where(self.size > p, grams[np.minimum(first + p, last)], 0))
        self.inner = [inner[max(w, 2)] for w in self.windows]
        e_at, pairs = _lists(edges)
        owner = np.repeat(np.arange(len(self.n)), np.diff(e_at))
        i, j = (np.asarray(pairs.field(f)).astype(np.int64) for f in ("i", "j"))
        self.n_edges = np.diff(e_at)
        apart = i != j
        self.edge_from, self.edge_to = self.at[owner[apart]] + i[apart], self.at[owner[apart]] + j[apart]
        order = np.lexsort((self.edge_to, self.edge_from))
        self.edge_from, self.edge_to = self.edge_from[order], self.edge_to[order]
        self.edge_at = np.searchsorted(self.edge_from, np.arange(len(self.size) + 1))
        self.edge_key = self.edge_from * (len(self.size) + 1) + self.edge_to

    def scores(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """The score of fragment b after a by window k, in millionths: half a millionth up, after the nudge of settle."""
        w, lead = self.windows[k], self.last[a]
        one = np.where(self.before[a] >= 0, self.table[(self.before[a] * LETTERS + lead) * LETTERS + self.first[b]], self.back)
        if w > 1:
            one = one + np.where(self.size[b] > 1, self.table[(lead * LETTERS + self.first[b]) * LETTERS + self.second[b]], 0)
        m = np.minimum(w, self.size[b])
        return (10 * (one + self.inner[k][b]) + 5001 * m) // (10_000 * m)

    def proved(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether an edge proves that fragment b follows a."""
        key = a * (len(self.size) + 1) + b
        place = np.searchsorted(self.edge_key, key)
        return (self.edge_key[np.minimum(place, len(self.edge_key) - 1)] == key) if len(self.edge_key) else np.zeros(key.shape, bool)


class Tile:
    """Sequences of a batch that have n fragments each."""

    def __init__(self, f: Fragments, which: np.ndarray):
        self.f, self.which, self.n = f, which, int(f.n[which[0]])
        self.base = f.at[which]
        self.ids = self.base[:, None] + np.arange(self.n)
        leads = f.leads[self.ids]
        self.starts = leads | ~leads.any(1, keepdims=True)
        self.rows = np.arange(len(which))
        self.kept: dict[int, np.ndarray] = {}
        self.marks: np.ndarray | None = None
        self.dense = self.n <= MATRIX

    def proved(self, rows: np.ndarray, i: np.ndarray) -> np.ndarray:
        """rows by n: which fragments an edge proves to follow fragment i."""
        if self.dense:
            if self.marks is None:
                self.marks = np.zeros((len(self.which), self.n, self.n), bool)
                self._mark(self.marks.reshape(-1, self.n), self.ids.ravel())
            return self.marks[rows, i]
        out = np.zeros((len(rows), self.n), bool)
        self._mark(out, self.base[rows] + i)
        return out

    def _mark(self, out: np.ndarray, of: np.ndarray) -> None:
        begin = self.f.edge_at[of]
        counts = self.f.edge_at[of + 1] - begin
        line = np.repeat(np.arange(len(of)), counts)
        to = self.f.edge_to[_places(begin, counts)]
        out[line, to - self.f.at[np.searchsorted(self.f.at, to, "right") - 1]] = True

    def scores(self, rows: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
        """rows by n: the scores of all fragments after fragment i."""
        if not self.dense:
            return self.f.scores((self.base[rows] + i)[:, None], self.ids[rows], k)
        if k not in self.kept:
            self.kept[k] = self.f.scores(self.ids[:, :, None], self.ids[:, None, :], k)
        return self.kept[k][rows, i]

    def impossible(self, rows: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.f.bad_end[self.base[rows] + i][:, None] | self.f.bad_start[self.ids[rows]]

    def start(self, k: int) -> np.ndarray:
        """The fragment that a greedy search starts with: see candidates.start."""
        incoming = np.zeros(self.ids.shape, np.int64)
        for i in range(self.n):
            at = np.full(len(self.rows), i)
            line = np.where(self.proved(self.rows, at), PROVED, self.scores(self.rows, at, k))
            line[:, i] = 0
            incoming += line
        return np.where(self.starts, incoming, NEVER).argmin(1)

    def greedy(self, k: int, bonus: int) -> tuple[np.ndarray, ...]:
        rows, n = self.rows, self.n
        path, used, forced = np.zeros((len(rows), n), np.int64), np.zeros((len(rows), n), bool), np.zeros(len(rows), np.int64)
        at = self.start(k)
        path[:, 0], used[rows, at] = at, True
        for step in range(1, n):
            never = self.impossible(rows, at)
            gain = np.where(self.proved(rows, at), PROVED + np.where(never, 0, bonus), self.scores(rows, at, k))
            cost = np.where(used, NEVER, np.where(never, NEVER // 2 - gain, -gain))
            at = cost.argmin(1)
            forced += never[rows, at]
            path[:, step], used[rows, at] = at, True
        return path, forced, np.full(len(rows), n)

    def beam(self, k: int, width: int, soft: bool, bonus: int) -> tuple[np.ndarray, ...]:
        """The same of a beam search; see candidates.beam."""
        n, total = self.n, len(self.rows)
        path, placed = np.zeros((total, n), np.int64), np.ones(total, np.int64)
        path[:, 0] = self.starts.argmax(1)
        if n == 1:
            return path, np.zeros(total, np.int64), placed

        def lines(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Gains, and which successors the rules allow."""
            proved = self.proved(rows, at)
            free = soft | ~proved.any(1, keepdims=True)
            return np.where(proved, PROVED + bonus, self.scores(rows, at, k)), ~self.impossible(rows, at) & (free | proved)

        def best(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The width least costs of each line, the first of equal ones first, and where they stand."""
            each = np.arange(len(cost))
            spots = np.empty((len(cost), min(width, cost.shape[1])), np.int64)
            costs = np.empty_like(spots)
            for x in range(spots.shape[1]):
                spots[:, x] = cost.argmin(1)
                costs[:, x] = cost[each, spots[:, x]]
                cost[each, spots[:, x]] = NEVER
            return costs, spots

        # The first step goes out from every start, so the best are kept as starts are passed.
        costs, heads, tails = np.full((total, 1), NEVER), np.zeros((total, 1), np.int64), np.zeros((total, 1), np.int64)
        for i in range(n):
            rows = np.flatnonzero(self.starts[:, i])
            if not len(rows):
                continue
            at = np.full(len(rows), i)
            gain, allowed = lines(rows, at)
            allowed[:, i] = False
            have = costs.shape[1]
            merged, spots = best(np.concatenate((costs[rows], np.where(allowed, -gain, NEVER)), 1))
            old, each = spots < have, np.arange(len(rows))[:, None]
            if have < merged.shape[1]:
                widen = lambda x, fill: np.concatenate((x, np.full((total, merged.shape[1] - have), fill)), 1)
                costs, heads, tails = widen(costs, NEVER), widen(heads, 0), widen(tails, 0)
            spot = np.minimum(spots, have - 1)
            new = np.where(old, heads[rows][each, spot], i), np.where(old, tails[rows][each, spot], spots - have)
            costs[rows, : merged.shape[1]], heads[rows, : merged.shape[1]], tails[rows, : merged.shape[1]] = merged, *new
        act = np.flatnonzero(costs[:, 0] < NEVER)
        costs, ways = costs[act], np.stack((heads[act], tails[act]), 2)
        path[act, :2], placed[act] = ways[:, 0], 2
        used = np.zeros((*costs.shape, n), bool)
        each, beams = np.arange(len(act))[:, None], np.arange(costs.shape[1])
        for x in range(2):
            used[each, beams, ways[:, :, x]] = True
        for step in range(2, n):
            if not len(act):
                break
            wide = costs.shape[1]
            rows = np.repeat(act, wide)
            gain, allowed = lines(rows, ways[:, :, -1].ravel())
            allowed &= ~used.reshape(-1, n) & (costs.ravel() < NEVER)[:, None]
            cost = np.where(allowed, costs.ravel()[:, None] - gain, NEVER).reshape(len(act), wide * n)
            costs, spots = best(cost)
            go = costs[:, 0] < NEVER
            act, costs, spots, ways, used = act[go], costs[go], spots[go], ways[go], used[go]
            each, parent, j = np.arange(len(act))[:, None], spots // n, spots % n
            ways = np.concatenate((ways[each, parent], j[:, :, None]), 2)
            used = used[each, parent]
            used[each, np.arange(costs.shape[1]), j] = True
            path[act, : step + 1], placed[act] = ways[:, 0], step + 1
        whole, rows = placed.copy(), np.flatnonzero(placed < n)
        left = np.ones((total, n), bool) if len(rows) else None
        if left is not None:
            line = np.repeat(np.arange(total), placed)
            left[line, path[line, _places(np.zeros(total, np.int64), placed)]] = False
        while len(rows):
            at = path[rows, whole[rows] - 1]
            gain = np.where(self.proved(rows, at), PROVED + bonus, self.scores(rows, at, k))
            j = np.where(left[rows], -gain, NEVER).argmin(1)
            path[rows, whole[rows]], left[rows, j] = j, False
            whole[rows] += 1
            rows = rows[whole[rows] < n]
        return path, np.zeros(total, np.int64), placed


def _tiles(f: Fragments) -> list[Tile]:
    order = np.argsort(f.n, kind="stable")
    order = order[f.n[order] > 0]
    tiles = []
    for group in np.split(order, np.flatnonzero(np.diff(f.n[order])) + 1) if len(order) else []:
        n = int(f.n[group[0]])
        most = max(1, TILE // (n * n if n <= MATRIX else n))
        tiles += [(group[k : k + most]) for k in range(0, len(group), most)]
    return tiles


def gram_counts(seqs: DataFrame) -> DataFrame:
    """gram, n: how often any three letters follow each other in seq, once for each task that reads seqs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, others = np.zeros(LETTERS**3, np.int64), Counter()
        for batch in batches:
            texts = batch.column(0).drop_null()
            buffer, off = _text(texts)
            if len(buffer) and not ((buffer >= 65) & (buffer <= 90)).all():
                for text in texts.to_pylist():
                    others.update(text[k : k + 3] for k in range(len(text) - 2))
            elif len(buffer) > 2:
                code = buffer.astype(np.int32) - 65
                inside = np.ones(len(code) + 1, bool)
                inside[off[1:]] = False
                whole = inside[1:-2] & inside[2:-1]
                total += np.bincount(((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:])[whole], minlength=LETTERS**3)
        for gram in np.flatnonzero(total).tolist():
            others["".join(chr(65 + gram // LETTERS**k % LETTERS) for k in (2, 1, 0))] += int(total[gram])
        yield pa.RecordBatch.from_arrays([pa.array(others.keys(), pa.string()), pa.array(others.values(), pa.int64())], ["gram", "n"])

    return seqs.select("seq").mapInArrow(counted, "gram string, n long")


def _shared(rows: int, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many keys two bags of each row share. x, y: the row and the key of each of them."""
    most = int(max((k.max(initial=-1) for _, k in (x, y)))) + 1
    (a, m), (b, n) = (np.unique(r * most + k, return_counts=True) for r, k in (x, y))
    both, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.bincount(both // max(most, 1), np.minimum(m[at], n[to]), rows).astype(np.int64)[:rows]


def distances(size_a: np.ndarray, a: np.ndarray, size_b: np.ndarray, b: np.ndarray, letters: int = LETTERS) -> np.ndarray:
    """The edit distance of each two texts: a, b are the codes (from 0, below letters) of all texts joined.

    Myers' columns of bits, a word for 64 letters of a, over all texts at once; the longest come first, so the texts that
    still have a letter of b are always the first ones.
    """
    wide = (size_a + 63) // 64
    order = np.lexsort((-size_b, wide))
    begin_a, begin_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    out = size_b.copy()
    for group in np.split(order, np.flatnonzero(np.diff(wide[order])) + 1) if len(order) else []:
        words = int(wide[group[0]])
        most = max(1, TILE // (letters * max(words, 1)))
        for some in (group[k : k + most] for k in range(0, len(group) if words else 0, most)):
            out[some] = _columns(size_a[some], begin_a[some], a, size_b[some], begin_b[some], b, words, letters)
    return out


def _columns(size_a: np.ndarray, begin_a: np.ndarray, a: np.ndarray, size_b: np.ndarray, begin_b: np.ndarray, b: np.ndarray, words: int, letters: int) -> np.ndarray:
    rows, one, top = len(size_a), np.uint64(1), np.uint64(63)
    equal, each = np.zeros((words, letters, rows), np.uint64), np.arange(rows)
    for p in range(int(size_a.max())):
        has = each[size_a > p]
        equal[p // 64, a[begin_a[has] + p], has] |= one << np.uint64(p % 64)
    plus, minus = np.full((words, rows), ~np.uint64(0)), np.zeros((words, rows), np.uint64)
    score, ends = size_a.copy(), ((size_a - 1) % 64).astype(np.uint64)
    live = np.searchsorted(-size_b, -np.arange(int(size_b[0])), "left")
    for t, n in enumerate(live.tolist()):
        letter = b[begin_b[:n] + t]
        up, down = np.ones(n, np.uint64), np.zeros(n, np.uint64)  # what comes in from the word below
        for w in range(words):
            eq, pv, mv = equal[w, letter, each[:n]], plus[w, :n], minus[w, :n]
            xv = eq | mv
            eq = eq | down
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            at = top if w < words - 1 else ends[:n]
            out_up, out_down = (ph >> at) & one, (mh >> at) & one
            ph, mh = (ph << one) | up, (mh << one) | down
            plus[w, :n], minus[w, :n] = mh | ~(xv | ph), ph & xv
            up, down = out_up, out_down
        score[:n] += up.astype(np.int64) - down.astype(np.int64)
    return score


def similarities() -> Callable[[Column | str, Column | str], Column]:
    """A function of an array of texts and a text: metrics.edit_similarity of each of the former with the latter."""

    def codes(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)

    def similar(texts: pa.Array, target: pa.Array) -> pa.Array:
        at, flat = _lists(texts)
        wanted = np.repeat(np.arange(len(texts)), np.diff(at)).tolist()
        targets, flat = target.to_pylist(), flat.to_pylist()
        out = [None if text is None or targets[r] is None else 1.0 for text, r in zip(flat, wanted)]
        open_ones = [k for k, x in enumerate(out) if x is not None and flat[k] != targets[wanted[k]]]
        left, right = [flat[k] for k in open_ones], [targets[wanted[k]] for k in open_ones]
        joined = np.concatenate((codes(left), codes(right)))
        kinds = np.flatnonzero(np.bincount(joined))
        number = np.zeros(int(kinds.max(initial=0)) + 1, np.int64)
        number[kinds] = np.arange(len(kinds))
        joined = number[joined]
        sizes = [np.array(list(map(len, x)), np.int64) for x in (left, right)]
        cut = int(sizes[0].sum())
        far = distances(sizes[0], joined[:cut], sizes[1], joined[cut:], max(1, len(kinds)))
        for k, d, most in zip(open_ones, far.tolist(), np.maximum(*sizes).tolist()):
            out[k] = 1 - d / most
        return _list_array(at, pa.array(out, pa.float64()))

    return F.arrow_udf(similar, "array<double>")


def compared(predicted: Sequence, true: Sequence) -> tuple[float, float]:
    """Longest correct run and Kendall's tau of two orders that may hold a fragment several times."""
    places: dict = {}
    for t in range(len(true) - 1, -1, -1):
        places.setdefault(true[t], []).append(t)
    # Runs of equal neighbours by the place where they end in the true order.
    best, ending = 0, {}
    for p in predicted:
        ending = {t: ending.get(t - 1, 0) + 1 for t in places.get(p, ())}
        best = max(best, *ending.values()) if ending else best
    met = [places[p].pop() for p in predicted if places.get(p)]
    signs = sum((t > s) - (t < s) for i, s in enumerate(met) for t in met[i + 1 :])
    return best / len(true) if true else 0.0, signs / (len(met) * (len(met) - 1) // 2) if len(met) > 1 else 0.0


class Measures:
    """The metrics of paths over a batch's fragments, which in order are the true sequence (metrics.order_metrics)."""

    def __init__(self, f: Fragments, pieces: pa.Array):
        self.f, self.kind = f, pieces.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = np.repeat(np.arange(len(f.n)), f.n)
        first = np.unique(np.stack((self.owner, self.kind)), axis=1, return_index=True)[1] if len(self.kind) else np.zeros(0, np.int64)
        self.repeats = np.bincount(self.owner, minlength=len(f.n)) != np.bincount(self.owner[first], minlength=len(f.n))
        self.length = np.bincount(self.owner, f.size, len(f.n)).astype(np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.code = f.text.astype(np.int64) - 65
        inner = self.owner[1:] == self.owner[:-1]
        self.true_pairs = self._pairs(np.flatnonzero(inner), np.flatnonzero(inner) + 1)
        self.true_grams = self._across(self.code, f.size)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.owner[a], self.kind[a] * (self.kind.max(initial=0) + 1) + self.kind[b]

    def _across(self, code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and gram of the grams of three letters that lie in no one fragment: those inside are in every order."""
        fragment = np.repeat(np.arange(len(sizes)), sizes)
        row = np.repeat(np.arange(len(self.length)), self.length)
        at = np.flatnonzero((row[2:] == row[:-2]) & (fragment[2:] != fragment[:-2])) if len(row) > 2 else np.zeros(0, np.int64)
        return row[at], (code[at] * LETTERS + code[at + 1]) * LETTERS + code[at + 2]

    def of(self, order: np.ndarray) -> dict[str, np.ndarray]:
        """order: the numbers of all fragments of the batch, in the predicted order of their sequences."""
        f, rows = self.f, len(self.length)
        code = self.code[_places(f.off[order], f.size[order])]
        wrong = np.bincount(np.repeat(np.arange(rows), self.length)[code != self.code], minlength=rows) > 0
        grams, across = np.maximum(self.length - 2, 0), np.bincount(self.true_grams[0], minlength=rows)
        made = self._across(code, f.size[order])
        # Orders have the grams inside fragments in common; what lies across joints is compared.
        alike = np.where(wrong, _shared(rows, made, self.true_grams), across) + grams - across
        inner = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        pairs = self._pairs(order[inner], order[inner + 1])
        apa = _shared(rows, pairs, self.true_pairs) / np.maximum(f.n - 1, 1)
        place = order - f.at[self.owner]
        lcr, tau = np.zeros(rows), np.zeros(rows)
        for which in _tiles(f):
            path = place[f.at[which][:, None] + np.arange(f.n[which[0]])]
            run = best = np.ones(len(which), np.int64)
            for k in range(1, path.shape[1]):
                run = np.where(path[:, k] == path[:, k - 1] + 1, run + 1, 1)
                best = np.maximum(best, run)
            lcr[which] = best / path.shape[1]
            if path.shape[1] > 1:
                pairs_of = path.shape[1] * (path.shape[1] - 1) // 2
                tau[which] = (2 * sum((path[:, k:] > path[:, :-k]).sum(1) for k in range(1, path.shape[1])) - pairs_of) / pairs_of
        for r in np.flatnonzero(self.repeats):
            mine = slice(f.at[r], f.at[r + 1])
            lcr[r], tau[r] = compared(self.kind[order[mine]].tolist(), self.kind[mine].tolist())
        far = np.zeros(rows, np.int64)
        letters = np.repeat(wrong, self.length)
        far[wrong] = distances(self.length[wrong], self.code[letters], self.length[wrong], code[letters])
        return {
            "exact_match": (~wrong).astype(float), "similarity": np.where(grams > 0, 2 * alike / np.maximum(2 * grams, 1), 1.0), "edit_similarity": 1 - far / np.maximum(self.length, 1),
            "apa": np.where(f.n > 1, apa, 0.0), "lcr": lcr, "tau": tau,
        }


def seeded(ids: list[int], n: np.ndarray, seed: int) -> np.ndarray:
    """Each sequence's places in the order of their draws (segment.shuffled), one sequence after the other."""
    names = [b"%d" % k for k in range(int(n.max(initial=0)))]
    out = []
    for i, size in zip(ids, n.tolist()):
        prefix = b"%d|%d|" % (seed, i)
        out += sorted(range(size), key=[md5(prefix + name).digest() for name in names[:size]].__getitem__)
    return np.array(out, np.int64)


def found(table: np.ndarray, back: int, settings: Sequence[dict], windows: Sequence[int], validity_window: int, made: bool = False, random: int | None = None) -> Callable[..., Column]:
    """A function of primary and edges: an array of FOUND, one for each setting (candidates.SETTING), whose order it keeps.

    path, forced, fell_back and placed are those of the search; realised counts the path's neighbours that an edge
    proves, unproved the others, and total sums their scores by validity_window, in millionths. With made, MADE is the
    fragments joined in the path's order. With random, a seed, the function takes the sequence's number besides, the
    order of that draw follows the settings', and all have MEASURES, settled (rounding.settle).
    """
    windows = list(windows)

    def alone(primary: pa.Array, edges: pa.Array) -> pa.Array:
        return search(primary, edges, None)

    def drawn(primary: pa.Array, edges: pa.Array, ids: pa.Array) -> pa.Array:
        return search(primary, edges, ids)

    def search(primary, edges, ids):
        f = Fragments(primary, edges, table, back, windows)
        many, rows = len(settings) + (random is not None), len(f.n)
        owner = np.repeat(np.arange(rows), f.n)
        paths = np.zeros((many, len(owner)), np.int64)
        forced, placed, realised, unproved, total = (np.zeros((rows, many), np.int64) for _ in range(5))
        if random is not None:
            paths[-1], placed[:, -1] = seeded(ids.to_pylist(), f.n, random), f.n
        for which in _tiles(f):
            tile = Tile(f, which)
            for s, setting in enumerate(settings):
                k, soft = windows.index(setting["window"]), setting["edges"] == "soft"
                bonus = round(float(setting["bonus"]) * 1e6) if soft else 0
                path, forced[which, s], placed[which, s] = tile.beam(k, setting["width"], soft, bonus) if setting["mode"] == "beam" else tile.greedy(k, bonus)
                paths[s][tile.ids] = path
                a, b = tile.base[:, None] + path[:, :-1], tile.base[:, None] + path[:, 1:]
                proved = f.proved(a, b)
                realised[which, s], unproved[which, s] = proved.sum(1), (~proved).sum(1)
                total[which, s] = np.where(proved, 0, f.scores(a, b, windows.index(validity_window))).sum(1)
        # Lists stand by sequence, then by setting.
        sizes = np.repeat(f.n, many)
        turned = np.argsort(np.repeat(np.arange(rows * many).reshape(rows, many).T, f.n, axis=1).ravel(), kind="stable")
        flat = paths.ravel()[turned]
        fields = [_list_array(np.concatenate(([0], np.cumsum(sizes))), pa.array(flat.astype(np.int32))), pa.array(forced.ravel().astype(np.int32)), pa.array(placed.ravel() < sizes), *(pa.array(x.ravel().astype(np.int32)) for x in (placed, realised, unproved)), pa.array(total.ravel())]
        names = ["path", "forced", "fell_back", "placed", "realised", "unproved", "total"]
        if made:
            order = flat + np.repeat(np.repeat(f.at[:-1], many), sizes)
            text = f.text[_places(f.off[order], f.size[order])]
            ends = np.cumsum(np.repeat(np.bincount(owner, f.size, rows).astype(np.int64), many))
            fields.append(pa.LargeStringArray.from_buffers(rows * many, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(text)).cast(pa.string()))
            names.append("made")
        if random is not None:
            measures = Measures(f, primary.flatten())
            each = [measures.of(path + f.at[owner]) for path in paths]
            fields += [pa.array(np.rint((np.stack([x[m] for x in each], 1).ravel() + 1e-10) * 1e6) / 1e6) for m in MEASURES]
            names += MEASURES
        return _list_array(np.arange(rows + 1) * many, pa.StructArray.from_arrays(fields, names))

    kind = ",".join([FOUND, *([MADE] if made else []), *(f"{m}:double" for m in MEASURES if random is not None)])
    return F.arrow_udf(alone if random is None else drawn, f"array<struct<{kind}>>")


def started(table: np.ndarray, back: int, window: int) -> Callable[[Column | str, Column | str], Column]:
    """A function of primary and edges: the fragment that a greedy search starts with."""

    def start(primary: pa.Array, edges: pa.Array) -> pa.Array:
        f = Fragments(primary, edges, table, back, (window,))
        out = np.zeros(len(f.n), np.int32)
        for which in _tiles(f):
            out[which] = Tile(f, which).start(0)
        return pa.array(out)

    return F.arrow_udf(start, "int")


def true_orders() -> Callable[[Column | str], Column]:
    """A function of the fragments of a sequence in order: the path of metrics.recover_true_order, null where there is none.
    The longest unused fragment that fits comes next, the first of equal ones."""

    def tiled(texts: list[str]) -> list[int] | None:
        whole, left, cursor, path = "".join(texts), sorted(range(len(texts)), key=lambda i: -len(texts[i])), 0, []
        while left:
            fits = next((k for k, i in enumerate(left) if whole.startswith(texts[i], cursor)), None)
            if fits is None:
                return None
            path.append(left.pop(fits))
            cursor += len(texts[path[-1]])
        return path

    def tile(primary: pa.Array) -> pa.Array:
        return pa.array(map(tiled, primary.to_pylist()), pa.list_(pa.int32()))

    return F.arrow_udf(tile, "array<int>")


class Steps:
    """The neighbours of a path in each row of a batch: their row, and the numbers of their fragments."""

    def __init__(self, f: Fragments, path: pa.Array):
        at, places = _lists(path)
        row = np.repeat(np.arange(len(path)), np.diff(at))
        number = places.to_numpy(zero_copy_only=False).astype(np.int64) + f.at[row]
        inner = row[1:] == row[:-1]
        self.row, self.a, self.b = row[1:][inner], number[:-1][inner], number[1:][inner]


def ranks(table: np.ndarray, back: int, window: int) -> Callable[..., Column]:
    """A function of primary, edges and a path: an array of rank and confirmed, one for each two neighbours of the path.
    The rank is 1 plus the first one's successors with a strictly better score."""

    def ranked(primary: pa.Array, edges: pa.Array, path: pa.Array) -> pa.Array:
        f = Fragments(primary, edges, table, back, (window,))
        steps = Steps(f, path)
        own, sizes = f.scores(steps.a, steps.b, 0), f.n[steps.row]
        rank = np.ones(len(own), np.int64)
        tile = np.cumsum(sizes) // (8 * TILE)
        for some in np.split(np.arange(len(own)), np.flatnonzero(np.diff(tile)) + 1) if len(own) else []:
            each = np.repeat(some, sizes[some])
            to = _places(f.at[steps.row[some]], sizes[some])
            better = (f.scores(steps.a[each], to, 0) > own[each]) & (to != steps.a[each])
            rank += np.bincount(each[better], minlength=len(rank))
        at = np.concatenate(([0], np.cumsum(np.bincount(steps.row, minlength=len(f.n)))))
        return _list_array(at, pa.StructArray.from_arrays([pa.array(rank.astype(np.int32)), pa.array(f.proved(steps.a, steps.b))], ["rank", "confirmed"]))

    return F.arrow_udf(ranked, "array<struct<rank:int,confirmed:boolean>>")


def unproved(table: np.ndarray, back: int, window: int) -> Callable[..., Column]:
    """A function of primary, edges and a path: struct of steps, the path's neighbours, of unproved, those that no edge proves,
    and of total, the sum of the latter's scores in millionths."""

    def summed(primary: pa.Array, edges: pa.Array, path: pa.Array) -> pa.Array:
        f = Fragments(primary, edges, table, back, (window,))
        steps = Steps(f, path)
        left = ~f.proved(steps.a, steps.b)
        total = np.zeros(len(f.n), np.int64)
        np.add.at(total, steps.row[left], f.scores(steps.a[left], steps.b[left], 0))
        counts = [np.bincount(r, minlength=len(f.n)) for r in (steps.row, steps.row[left])]
        return pa.StructArray.from_arrays([*(pa.array(c.astype(np.int64)) for c in counts), pa.array(total)], ["steps", "unproved", "total"])

    return F.arrow_udf(summed, "struct<steps:bigint,unproved:bigint,total:bigint>")
