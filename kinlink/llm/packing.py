"""Hierarchical packing of documents into sequences of several context sizes.

Each document's ids are cut into whole windows of the longest tier and a rest; the rest is routed to the shortest
tier that holds it. Tiers are packed from the longest down: a rest opens a window of its tier, the gap behind it
is filled with the longest rests of shorter tiers that fit, and what still gapes takes the head of another rest,
whose tail is routed anew. So every window is full but the last of a task, whose pieces are laid into windows of
falling powers of two: no sequence needs padding. Full windows are then balanced over step groups of about equal
tokens, the longest first and each to the emptiest group.

A task packs its own input partition in pools of bounded size, with no shuffle, so a hot source or a long
document is no hot task. Memory is a pool and the longest document.

Defined results: a null or empty text has the end id alone. A null id stays null. Repeated rows are packed as rows
of their own. An empty table gives no rows. Other columns are ignored. Sequences are numbered within a task, with
the task's partition in the upper bits, so their ids have gaps.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import named, ship, table, tidy
from kinlink.llm.tokens import KEEP, encoder

AT_ONCE = 256
TIERS = (256, 512, 1024, 2048, 4096)
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


class Packer:
    """Takes documents with add(), gives closed sequences with flush(): lists of (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) or t < 1 for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers are rising powers of two")
        self.tiers, self.longest = tiers, tiers[-1]
        self.docs: list[tuple] = []
        self.rests: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), ascending
        self.full: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.tokens = 0

    def add(self, doc: tuple, n: int) -> None:
        d, at = len(self.docs), 0
        self.docs.append(doc)
        self.tokens += n
        while n - at >= self.longest:
            self.full.append((self.longest, [(d, at, self.longest)]))
            at += self.longest
        self._route(d, at, n - at)

    def _route(self, d: int, at: int, length: int) -> None:
        if length:
            insort(self.rests[next(t for t in self.tiers if t >= length)], (length, d, at))

    def _fill(self, tier: int, gap: int, window: list[tuple[int, int, int]]) -> int:
        for t in reversed([t for t in self.tiers if t <= tier]):
            rests = self.rests[t]
            while gap and (k := bisect_right(rests, (gap, 1 << 62, 0))):
                length, d, at = rests.pop(k - 1)
                window.append((d, at, length))
                gap -= length
        if gap:
            for t in self.tiers:
                if t <= tier and self.rests[t]:
                    length, d, at = self.rests[t].pop()
                    window.append((d, at, gap))
                    self._route(d, at + gap, length - gap)
                    return 0
        return gap

    def pack(self, last: bool) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """The closed windows (tier, pieces). Rests of a window that can't be filled wait, but in the last call."""
        waiting: list[tuple[int, int, int]] = []
        for tier in reversed(self.tiers):
            while self.rests[tier]:
                length, d, at = self.rests[tier].pop()
                window = [(d, at, length)]
                if self._fill(tier, tier - length, window):
                    waiting += window
                else:
                    self.full.append((tier, window))
        if last:
            self._tail(waiting)
        else:
            for d, at, length in waiting:
                self._route(d, at, length)
        closed, self.full = self.full, []
        return closed

    def _tail(self, pieces: list[tuple[int, int, int]]) -> None:
        """Lays what is left into windows of falling powers of two."""
        total = sum(p[2] for p in pieces)
        pieces = pieces[::-1]
        while total:
            size = min(self.longest, 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                d, at, length = pieces.pop()
                take = min(length, gap)
                window.append((d, at, take))
                if take < length:
                    pieces.append((d, at + take, length - take))
                gap -= take
            self.full.append((size, window))
            total -= size

    def forget(self) -> None:
        """Drops the documents that no waiting rest belongs to."""
        rests = [r for rs in self.rests.values() for r in rs]
        renamed = {d: i for i, d in enumerate(sorted({r[1] for r in rests}))}
        self.docs = [self.docs[d] for d in renamed]
        self.rests = {t: sorted((n, renamed[d], at) for n, d, at in rs) for t, rs in self.rests.items()}
        self.tokens = sum(r[0] for r in rests)


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A step group for each sequence: the longest first, each to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = groups[0]
        out[i] = g
        heapq.heapreplace(groups, (load + sizes[i], g))
    return out


def _pack(vocabulary: str, end_id: int, tiers: tuple[int, ...], pool_tokens: int, step_tokens: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary, end_id, keep).encode, Packer(tiers)
        first = TaskContext.get().partitionId() << 33
        made = [first, first]

        def emit(last: bool) -> pa.RecordBatch:
            closed, rows = packer.pack(last), []
            for (tier, window), group in zip(closed, step_groups([t for t, _ in closed], step_tokens)):
                offset = 0
                for d, at, length in window:
                    key, ids = packer.docs[d]
                    rows.append((key, at, length, ids[4 * at : 4 * (at + length)], len(ids) // 4, made[0], offset, tier, made[1] + group))
                    offset += length
                made[0] += 1
            made[1] = max([made[1], *(r[8] + 1 for r in rows)])
            packer.forget()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(_NAMES), _TYPES)], _NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    packer.add((key, ids), len(ids) // 4)
                    if packer.tokens >= pool_tokens:
                        yield emit(False)
        yield emit(True)

    return run


def pack_documents(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", end_id: int = 2, tiers: tuple[int, ...] = TIERS,
    pool_tokens: int = 1 << 20, step_tokens: int = 1 << 15, keep: int = KEEP,
) -> DataFrame:
    """The pieces (PIECES) of all documents; ids are little-endian unsigned 32-bit. keep: how many words' ids a worker remembers, memory for time."""
    ship(docs.sparkSession)
    own = docs.select(F.col(named(key)).cast("long").alias("key"), F.col(named(text)).cast("string").alias("text"))
    return own.mapInArrow(tidy(_pack(vocabulary, end_id, tuple(tiers), pool_tokens, step_tokens, keep)), PIECES)


def with_digests(pieces: DataFrame) -> DataFrame:
    """ids give way to their crc32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents."""
    return with_digests(pack_documents(table(spark, sf_dir, "documents")))
