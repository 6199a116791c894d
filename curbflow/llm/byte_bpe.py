"""Byte-level BPE with padded matrices of words.

A text is split by the vocabulary's pattern; every piece is encoded by itself. The pieces
of a batch that are not yet known become rows of matrices, grouped by length and filled up
to the width of their group. In each round every row merges its leftmost pair of smallest
rank: the ranks of all neighbours come from a hash table held in arrays, the merged place
is closed up, and rows without a mergeable pair leave the matrix.

Long pieces would take as many rounds as they have bytes. Above ``WIDEST`` bytes a piece
goes through a heap of its pairs, which merges in the same order.

Cases: a null or empty text has no tokens. Any text length: a text is read in slices of
pieces, and a piece of any length is encoded whole. Repeated rows are each answered. Empty
table: empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import map_rows

WIDEST = 128  # bytes of a piece that goes through the matrices
CELLS = 1 << 20  # ids of a matrix
KNOWN_BYTES = 48 << 20  # what a worker remembers of pieces
SLICE = 100_000  # pieces of a text handled at a time
NONE = np.int32(2**31 - 1)  # rank of a pair that does not merge

_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of pairs of ids: open addressing in arrays, looked up for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = self._key(left, right)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            # of several keys for one free slot the last written stays; the others go on
            self.keys[slot[todo[free]]] = keys[todo[free]]
            placed = self.keys[slot[todo]] == keys[todo]
            self.ranks[slot[todo[placed]]] = merged[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << np.int64(32) | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _ODD) >> self.shift).view(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank (and id) that each pair merges to, or ``NONE``."""
        keys = self._key(left, right).ravel()
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out.reshape(left.shape)


class ByteBPE:
    """A vocabulary of byte strings with ranks, and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # a pair merges wherever its bytes together are a token
        parts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(parts, np.int64).reshape(-1, 3).T
        self.table = PairTable(left, right, merged.astype(np.int32))
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.held = 0

    def merged_rows(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final ids and lengths of padded rows (padding is -1)."""
        out, out_length = ids.copy(), length.copy()
        rows = np.arange(len(ids))
        while len(rows):
            width = int(length.max())
            if width < 2:
                break
            ids = ids[:, :width]
            place = np.arange(width - 1)
            inside = place[None, :] < (length - 1)[:, None]
            ranks = np.where(inside, self.table.ranks_of(ids[:, :-1], ids[:, 1:]), NONE)
            at = ranks.argmin(axis=1)  # the leftmost of the smallest
            best = ranks[np.arange(len(rows)), at]
            going = best < NONE
            if not going.all():  # rows that are done leave
                done = ~going
                out[rows[done], :width], out_length[rows[done]] = ids[done], length[done]
                ids, length, rows, at, best = ids[going], length[going], rows[going], at[going], best[going]
                if not len(rows):
                    break
            # compaction: what stands after the merged pair moves one to the left
            moved = np.where(place[None, :] > at[:, None], ids[:, 1:], ids[:, :-1])
            moved[np.arange(len(rows)), at] = best
            ids, length = moved, length - 1
        if len(rows):
            out[rows, : ids.shape[1]], out_length[rows] = ids, length
        return out, out_length

    def merged_long(self, piece: bytes) -> list[int]:
        """Ids of one long piece by a heap of its pairs, in the same order of merges."""
        n, ranks = len(piece), self.ranks
        start_of_next = list(range(1, n + 1))  # the end of the part that starts here
        before = list(range(-1, n - 1))
        alive = bytearray(b"\x01") * n
        heap = []

        def offer(i: int) -> None:
            j = start_of_next[i]
            if j < n:
                rank = ranks.get(piece[i : start_of_next[j]])
                if rank is not None:
                    heap.append((rank, i, j, start_of_next[j])) if not ready else heapq.heappush(heap, (rank, i, j, start_of_next[j]))

        ready = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not alive[i] or start_of_next[i] != j or not alive[j] or start_of_next[j] != end:
                continue  # one of its parts has changed
            alive[j] = 0
            start_of_next[i] = end
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : start_of_next[i]]])
            i = start_of_next[i]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of every piece: short ones through matrices by length, the others one by one."""
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        for i in np.flatnonzero(sizes > WIDEST).tolist():
            out[i] = self.merged_long(pieces[i])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= WIDEST]
        # a bucket: widths up to the next power of two, so at most half is padding
        bucket = np.ceil(np.log2(np.maximum(sizes[order], 1))).astype(int)
        for part in np.split(order, np.flatnonzero(np.diff(bucket)) + 1) if len(order) else []:
            width = int(sizes[part].max())
            for at in range(0, len(part), max(1, CELLS // max(width, 1))):
                some = part[at : at + max(1, CELLS // max(width, 1))]
                length = sizes[some]
                ids = np.full((len(some), width), -1, np.int32)
                ids[np.arange(width)[None, :] < length[:, None]] = self.single[
                    np.frombuffer(b"".join([pieces[i] for i in some.tolist()]), np.uint8)
                ]
                ids, length = self.merged_rows(ids, length)
                flat = ids[np.arange(width)[None, :] < length[:, None]].tolist()
                ends = np.cumsum(length).tolist()
                for i, s, e in zip(some.tolist(), [0, *ends], ends):
                    out[i] = flat[s:e]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Remember the pieces' ids as text and what these decode to, within a bound of bytes."""
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        if self.held > KNOWN_BYTES:
            self.known.clear()
            self.held = 0
            new = list(pieces)
        for p, ids in zip(new, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])):
            text, raw = " ".join(map(str, ids)), self.decode(ids)
            self.known[p] = (len(ids), text, raw)
            self.held += 250 + 4 * len(p) + len(text) + len(raw)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def slices(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, so many at a time."""
        if len(text) <= SLICE:
            yield self.pieces.findall(text)
            return
        found = (m.group() for m in self.pieces.finditer(text))
        while part := list(islice(found, SLICE)):
            yield part

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.slices(text):
            self.learn(set(part))
            out += [int(i) for p in part for i in self.known[p][1].split()]
        return out


_VOCABULARIES: dict[tuple[str, str], ByteBPE] = {}


def vocabulary(path: str, pattern: str) -> ByteBPE:
    """One for each Python worker."""
    if (path, pattern) not in _VOCABULARIES:
        _VOCABULARIES[path, pattern] = ByteBPE(path, pattern)
    return _VOCABULARIES[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids``, an array of the token ids of each text."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = vocabulary(path, pattern)
        for b in batches:
            yield {"doc_id": b.column(0), "ids": [bpe.encode(t) for t in b.column(1).to_pylist()]}

    return map_rows(texts, run, "doc_id bigint, ids array<int>", batch=100)


def decode_documents(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``raw``, the bytes that the ids of each row stand for; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = vocabulary(path, pattern)
        for b in batches:
            yield {"doc_id": b.column(0), "raw": [bpe.decode(own or []) for own in b.column(1).to_pylist()]}

    return map_rows(ids.select("doc_id", "ids"), run, "doc_id bigint, raw binary", batch=100)


def document_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, and its ids decoded."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = vocabulary(path, pattern)
        for b in batches:
            found = [bpe.pieces.findall(t) if len(t) <= SLICE else None for t in b.column(1).to_pylist()]
            bpe.learn(set().union(*[f for f in found if f]))  # short texts of a batch share their matrices
            texts, out = b.column(1).to_pylist(), [(0, "", "")] * b.num_rows
            # long texts last: what they bring may empty the memory
            for at in sorted(range(len(texts)), key=lambda i: found[i] is None):
                own, n, ids, raw, first = found[at], 0, hashlib.sha256(), hashlib.sha256(), True
                for part in [own] if own is not None else bpe.slices(texts[at]):
                    if own is None:
                        bpe.learn(set(part))
                    held = [bpe.known[p] for p in part]
                    if held:
                        n += sum([h[0] for h in held])
                        ids.update(((" " if not first else "") + " ".join([h[1] for h in held])).encode())
                        raw.update(b"".join([h[2] for h in held]))
                        first = False
                out[at] = (n, ids.hexdigest(), raw.hexdigest())
            n, ids, raw = map(list, zip(*out)) if out else ([], [], [])
            yield {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": raw}

    return map_rows(texts, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", batch=100)
