"""Byte-level BPE encoding and decoding (operator 10).

Each match of the pattern is encoded on its own. Its bytes are read as Latin-1 characters, an Aho-Corasick
automaton finds every vocabulary entry in them, and the encoder takes the longest entry at each place,
going back to shorter ones wherever the entry cannot stand next to the token before it. Two tokens can
stand together exactly if merging their joined bytes gives those two tokens again; the answer is found by
undoing merges on either side of the seam and is remembered. Places that were left once are never entered
again, so the work stays linear in the length. A chain of tokens that are pairwise compatible is the
result of the merges, so the ids equal those of rank-ordered merging.

Edge cases: a null or empty text has no tokens, and its ids and its decoded bytes are empty strings
(hashes of the empty string). Any length is encoded whole. Repeated rows and repeated ids each give their
row. An empty table gives an empty result. Columns other than doc_id and text are not read, so clashing
names do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import documents_rows, small_batches

#: Entries that a worker remembers, for chunks, pieces and pairs of tokens each. Chunks have two generations
#: of half as many: what is met again moves to the young one, and a full young one replaces the old one.
MEMO = 400_000

#: The characters with Unicode's White_Space property, which the pattern's \\s stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Patterns whose matches never go on from another character into white space.
CUT_AT_WHITE = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a .tiktoken file: a base64 token and its rank on each line. Bounded by the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes and decodes by ranks; one for each worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.cut = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+" if pattern in CUT_AT_WHITE else r"(?s).+").findall
        self.token_of = dict(sorted((rank, token) for token, rank in ranks.items()))
        self.length = {rank: len(token) for rank, token in self.token_of.items()}
        self.automaton = ahocorasick.Automaton()
        for rank, token in self.token_of.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for rank, token in self.token_of.items():
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), None)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.together: dict[int, bool] = {}
        for rank, token in self.token_of.items():
            left = self.shorter[rank]
            while left is not None:
                right = ranks.get(token[self.length[left] :])
                if right is not None and left < rank and right < rank and self._compatible(left, right):
                    self.parts[rank] = left, right
                    self.merged[left, right] = rank
                    break
                left = self.shorter[left]
        self.together.clear()
        self.pieces: dict[str, list[int]] = {}
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Do merges of the two tokens' joined bytes end in these two tokens?

        Undo the later of the merges that made them, on its side of the seam. If tokens that face each other
        have a merge that comes before the merge undone last, it would have been made instead.
        """
        before = float("inf")
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < before:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # Of equal ranks the left one was merged first, so the right one is undone first.
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def compatible(self, left: int, right: int) -> bool:
        if len(self.together) >= MEMO:
            self.together.clear()
        known = self.together[left << 32 | right] = self._compatible(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        text = piece.encode().decode("latin-1")
        size, length, shorter, together = len(text), self.length, self.shorter, self.together.get
        longest = [0] * size
        for end, (rank, before) in self.automaton.iter(text):
            longest[end - before] = rank  # ends ascend, so the longest is written last
        token: int | None = longest[0]
        if length[token] == size:
            return [token]
        closed: set[int] = set()
        tokens: list[int] = []
        at, last = 0, -1
        while at < size:
            while token is not None:
                end = at + length[token]
                if end not in closed:
                    if last < 0:
                        break
                    known = together(last << 32 | token)
                    if known or known is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token is None:
                closed.add(at)
                token = tokens.pop()
                at -= length[token]
                last = tokens[-1] if tokens else -1
            else:
                tokens.append(token)
                at, last = end, token
                token = longest[at] if at < size else None
        return tokens

    def _piece(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        if known is None:
            known = self.encode_piece(piece)
            if len(piece) <= 64:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def _chunk(self, chunk: str) -> tuple[tuple[int, ...], str]:
        """Ids of a chunk and the same in decimal, joined by commas."""
        known = self.known.get(chunk) or self.older.get(chunk)
        if known is None:
            ids = [rank for piece in self.pattern.findall(chunk) for rank in self._piece(piece)]
            known = tuple(ids), ",".join(map(str, ids))
        if len(chunk) <= 64:
            if len(self.known) >= MEMO // 2:
                self.known, self.older = {}, self.known
            self.known[chunk] = known
        return known

    def chunks(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """The text's chunks, encoded: white space and what follows it up to the next white space.

        No match of the pattern goes on from another character into white space, and what it looks at
        behind a run of white space is in the same chunk. So the text may be cut before every run. A pattern
        that doesn't start its matches over at white space in this way is not cut (see __init__).
        """
        get, chunk = self.known.get, self._chunk
        return [get(x) or chunk(x) for x in self.cut(text)]

    def encode(self, text: str) -> list[int]:
        return [rank for ids, _ in self.chunks(text) for rank in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def worker_encoder(shared, pattern: str) -> Encoder:
    """The encoder of this worker process, built once from the broadcast ranks."""
    key = shared.id if hasattr(shared, "id") else id(shared), pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value, pattern)
    return _ENCODERS[key]


def broadcast_ranks(spark: SparkSession, path: str):
    """The vocabulary as a broadcast: its size is that of the vocabulary file, whatever the data."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, n_tokens and n_bytes of every text: the operator's own output."""
    shared = broadcast_ranks(docs.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, pattern)
        for batch in batches:
            for part in small_batches(batch):
                texts = part.column("text").to_pylist()
                ids = [encoder.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())],
                    names=["doc_id", "ids", "n_tokens", "n_bytes"],
                )

    return documents_rows(docs).mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long, n_bytes long")


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of rows with doc_id and ids; null ids decode to no bytes."""
    shared = broadcast_ranks(encoded.sparkSession, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, pattern)
        for batch in batches:
            raw = [encoder.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    No shuffle: a map over the scan, with the vocabulary broadcast.
    """
    shared = broadcast_ranks(docs.sparkSession, vocabulary)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, pattern)
        for batch in batches:
            for part in small_batches(batch):
                counts, ids_hex, decoded_hex = [], [], []
                for text in part.column("text").to_pylist():
                    chunks = encoder.chunks(text)
                    ids: list[int] = []
                    for x, _ in chunks:
                        ids += x
                    counts.append(len(ids))
                    ids_hex.append(hashlib.sha256(",".join([x for _, x in chunks]).encode()).hexdigest())
                    decoded_hex.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents_rows(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_lengths(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens of every text."""
    shared = broadcast_ranks(docs.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, pattern)
        for batch in batches:
            for part in small_batches(batch):
                n = [sum(len(x) for x, _ in encoder.chunks(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents_rows(docs).mapInArrow(count, "doc_id long, n_tokens long")
