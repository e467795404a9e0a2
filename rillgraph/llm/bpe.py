"""Byte-level BPE by a rank queue under a hierarchical bitmap.

A pre-token's bytes form a linked list. Every adjacent pair that the rank table knows waits in the bucket of its merge
rank, as the position of its left token. A two-level bitmap marks the buckets that aren't empty, so find-first-set
gives the next rank in constant time; entries whose pair has changed meanwhile are recognised as stale and skipped. One
merge costs O(1) bitmap steps plus O(log bucket), whatever the length of the pre-token.

Null texts count as empty and give no ids. A text is always encoded whole; invalid UTF-8 is read with
replacement characters. Extra columns pass through ``encode`` and
``decode`` unchanged; if the output name is already taken, the operator raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import python_texts, shipped

#: Words whose ids a worker remembers; beyond it, the memory is emptied and filled again.
REMEMBERED = 600_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The rank table of a ``.tiktoken`` file: base64 token and rank on each line."""
    ranks = {}
    for line in content.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class _Memory(dict):
    """Pre-token to ids; a miss is computed and kept."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self._compute, self._limit = compute, limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self._limit:
            self.clear()
        ids = self._compute(piece)
        if len(piece) <= 64:  # long pre-tokens hardly come again
            self[piece] = ids
        return ids


class ByteBPE:
    """Encoder and decoder for one rank table and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.split = regex.compile(pattern).findall
        self.memory = _Memory(self._piece, remembered)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.merge(data)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: always the pair of lowest rank first, leftmost among equals."""
        known = self.ranks.get
        n = len(data)
        end = list(range(1, n + 1))  # where the token that starts here ends, and so where the next one starts
        before = list(range(-1, n - 1))  # where the token before starts
        waiting: list = [None] * n  # rank of the pair whose left token starts here
        buckets: dict[int, list[int]] = {}
        summary, words = 0, {}  # bit w of summary: words[w] isn't 0; bit b of words[w]: bucket 256 w + b isn't empty
        for at in range(n - 1):
            rank = known(data[at : at + 2])
            if rank is not None:
                waiting[at] = rank
                if rank in buckets:
                    buckets[rank].append(at)
                else:
                    buckets[rank] = [at]
                    w = rank >> 8
                    words[w] = words.get(w, 0) | 1 << (rank & 255)
                    summary |= 1 << w
        while summary:
            w = (summary & -summary).bit_length() - 1
            word = words[w]
            low = word & -word
            rank = (w << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[w] = word = word ^ low
                if not word:
                    summary ^= 1 << w
            if waiting[at] != rank:
                continue  # stale
            middle = end[at]
            waiting[middle] = None
            stop = end[at] = end[middle]
            if stop < n:
                before[stop] = at
                waiting[at] = new = known(data[at : end[stop]])
            else:
                waiting[at] = new = None
            left = before[at]
            for start in (left, at):
                if start < 0:
                    continue
                if start == left:
                    waiting[left] = new = known(data[left:stop])
                else:
                    new = waiting[at]
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], start)
                    else:
                        buckets[new] = [start]
                        w = new >> 8
                        words[w] = words.get(w, 0) | 1 << (new & 255)
                        summary |= 1 << w
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[data[at : end[at]]])
            at = end[at]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memory.__getitem__, self.split(text)))) if text else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def _loaded(content: bytes, pattern: str) -> ByteBPE:
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(read_ranks(content), pattern)
    return _LOADED[key]


def _mapped(df: DataFrame, path: str, pattern: str, added: T.StructType, work) -> DataFrame:
    """Each Arrow batch of ``df`` with the columns that ``work(bpe, batch)`` returns."""
    if taken := {f.name.lower() for f in added} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns already there: {sorted(taken)}")
    with open(path, "rb") as f:
        sent = shipped(df.sparkSession, f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(sent.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                new = work(bpe, part)
                yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], names=[*part.schema.names, *new])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``array<int>``."""

    def work(bpe: ByteBPE, batch: pa.RecordBatch) -> dict:
        return {out: pa.array([bpe.encode(t) for t in python_texts(batch.column(text))], pa.list_(pa.int32()))}

    return _mapped(df, path, pattern, T.StructType().add(out, T.ArrayType(T.IntegerType())), work)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each id sequence (null: empty). An id that the table lacks raises ``KeyError``."""

    def work(bpe: ByteBPE, batch: pa.RecordBatch) -> dict:
        return {out: pa.array([bpe.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.binary())}

    return _mapped(df, path, pattern, T.StructType().add(out, T.BinaryType()), work)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encode and decode in one pass, of which only digests leave the worker."""

    def work(bpe: ByteBPE, batch: pa.RecordBatch) -> dict:
        counts, of_ids, of_bytes = [], [], []
        for t in python_texts(batch.column(text)):
            ids = bpe.encode(t)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids), "decoded_sha256": pa.array(of_bytes)}

    added = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return _mapped(df, path, pattern, added, work)
