"""Near-duplicate documents by SimHash, with pigeonring filtering of candidate pairs.

A fingerprint has 64 bits in `SEGMENTS` (5) consecutive segments, seen as a ring. If two fingerprints differ in at
most `radius` (4) bits, then from some segment on every chain of l consecutive segments differs in at most
l * radius / SEGMENTS bits, so in 0, 1, 2, 3 and 4 bits for l = 1 to 5. The filter joins on the first two links
of the chain: equal segments (shuffled by), and a following segment within one bit (looked up in a sorted index);
the further links prune before the full Hamming check.

Equal fingerprints are one node before anything is joined. A block, the fingerprints with one segment's value, is
split into parts of at most `part_rows` where it is larger, and every two of its parts meet in one task: memory is
bounded whatever a block holds. The number of blocks is at most 5 * 8192, so their sizes are broadcast. A task
returns a spanning forest of its links, not the links: fingerprints that it has already connected, most of all
those around one pivot, are not compared again, so a large group of near copies gives one edge a member.
Components are found by large-star and small-star rounds over the edges, with minima by aggregation, never by lists.

With a `similarity`, as the corpus pipeline asks for, texts are linked by the exact Jaccard similarity of their sets of
shingles instead. Sets 0.8 alike differ in about 19 of 128 bits, give or take 4, so the radius is `WIDE` (40) bits; no
index of such a radius prunes by itself, so fingerprints are compared among texts that share a key. A text's keys are
the first of its shingles in one order of all, those that many texts hold last and the rest by hash. Two sets so
alike share one of their first n - ceil(similarity * n) + 1; a text of more takes as many that the chance of no common
key is below `MISS` (1e-10) a pair, in most texts 17. Sets that are equal are one node. Texts that share a key and are
within the radius, directly or through others, are a cluster; a cluster's sets meet in one task, or where it is large
every two of its parts do, and are compared exactly there. A task sends a spanning forest of its links, so what leaves
it grows with the texts and not with their pairs.

Defined results: a null or empty text has fingerprint zero, linked like any other. A text shorter than a shingle is
one shingle. Repeated rows stay rows, with one component. A null doc_id is no component's name unless the whole
component has none. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import columns_of, materialise, named, no_clash, not_in, only_in, ship, spread_join, table, tidy

WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
SEGMENTS, RADIUS = len(WIDTHS), 4
WIDE, MISS = 40, 1e-10
BUCKET_BITS, CHUNK = 20, 1 << 12


def simhash(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's shingles of size words, ASCII letters lowered."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes split at ASCII white space only
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = np.array([xxh64_intdigest(s, seed) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _fingerprinter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([simhash(t.as_py(), size) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), found], ["doc_id", "text_hash", "fp"])

    return run


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of every document."""
    ship(docs.sparkSession)
    own = docs.select(F.col(named(key)).cast("long").alias("doc_id"), F.col(named(text)).cast("string").alias("text"))
    return own.withColumn("text_hash", F.xxhash64("text")).mapInArrow(tidy(_fingerprinter(size)), "doc_id long, text_hash long, fp long")


def segment(fp: np.ndarray, i: int) -> np.ndarray:
    i %= SEGMENTS
    return (fp >> np.uint64(STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


class Forest:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                return above
            self.up = above

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def chained(a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
    """Whether the chains of every length from segment i on keep to their budgets; the last is the Hamming check."""
    diff = a ^ b
    keeps, total = np.ones(len(diff), bool), np.zeros(len(diff), np.int64)
    for link in range(SEGMENTS):
        total = total + np.bitwise_count(segment(diff, i + link))
        keeps &= total <= (link + 1) * RADIUS // SEGMENTS
    return keeps


def _dense(fp: np.ndarray, members: np.ndarray, forest: Forest, edges: list[tuple[int, int]]) -> None:
    """Connects what is linked among many members by pivots: a pivot is held only against members of other components, and joins those it reaches."""
    of = forest.roots()[members]
    for p in range(len(members) - 1):
        other = np.flatnonzero(of[p + 1 :] != of[p]) + p + 1
        if not len(other):
            if (of == of[p]).all():
                return
            continue
        near = other[np.bitwise_count(fp[members[other]] ^ fp[members[p]]) <= RADIUS]
        if len(near):
            reached, first = np.unique(of[near], return_index=True)
            for x in near[first]:
                forest.join(int(members[p]), int(members[x]))
                edges.append((int(members[p]), int(members[x])))
            of[np.isin(of, reached)] = of[p]


def links(fp: np.ndarray, i: int, dense: int = 512) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places in fp, of the pairs whose chain from segment i on keeps to its budgets. All of fp agree in segment i."""
    n, edges = len(fp), []
    if n < 2:
        return edges
    forest = Forest(n)
    second = segment(fp, i + 1).astype(np.int64)
    order = np.argsort(second, kind="stable")
    values, begin, count = np.unique(second[order], return_index=True, return_counts=True)
    flips = np.array([0, *(1 << k for k in range(WIDTHS[(i + 1) % SEGMENTS]))])
    other = values[None, :] ^ flips[:, None]
    at = np.minimum(np.searchsorted(values, other), len(values) - 1)
    f, v = np.nonzero((values[at] == other) & (values[None, :] <= other) & ((flips[:, None] > 0) | (count[None, :] > 1)))
    w = at[f, v]
    size = count[v] * count[w]
    single = size == 1
    pairs = [(order[begin[v[single]]], order[begin[w[single]]])]
    waiting = int(single.sum())

    def compare() -> None:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        keep = chained(fp[a], fp[b], i)
        for x, y in zip(a[keep].tolist(), b[keep].tolist()):
            if forest.join(x, y):
                edges.append((x, y))

    for k in np.flatnonzero(~single):
        left, right = (order[begin[j] : begin[j] + count[j]] for j in (v[k], w[k]))
        if size[k] > dense * dense:
            _dense(fp, np.unique(np.concatenate([left, right])), forest, edges)
            continue
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        pairs.append((a[a < b], b[a < b]) if v[k] == w[k] else (a, b))
        waiting += len(a)
        if waiting > 1 << 20:
            compare()
            pairs, waiting = [], 0
    if waiting:
        compare()
    return edges


def _linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a block's rows may span batches."""
    held: list[np.ndarray] = []
    block = None

    def done() -> list[tuple[int, int]]:
        if block is None or sum(map(len, held)) < 2:
            return []
        fp = np.unique(np.concatenate(held))
        signed = fp.view(np.int64)
        return [(int(signed[a]), int(signed[b])) for a, b in links(fp, block[0])]

    out: list[tuple[int, int]] = []

    def batch_of(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        start, value, p, q, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        fp = fp.astype(np.int64).view(np.uint64)
        new = np.flatnonzero((np.diff(start) != 0) | (np.diff(value) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(fp)]):
            this = (int(start[lo]), int(value[lo]), int(p[lo]), int(q[lo]))
            if this != block:
                out += done()
                held, block = [], this
            held.append(fp[lo:hi].copy())
        if len(out) > 1 << 16:
            yield batch_of(out)
            out = []
    out += done()
    yield batch_of(out)


def near_links(fps: DataFrame, *, part_rows: int = 1 << 16) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in the column fp: within each component of the true links they connect all, and every edge is a true link."""
    ship(fps.sparkSession)
    mask = [(1 << w) - 1 for w in WIDTHS]
    rows = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("start"), F.shiftrightunsigned("fp", STARTS[i]).bitwiseAND(F.lit(mask[i])).alias("value")) for i in range(SEGMENTS)))).alias("s"))
    rows = rows.select("s.*", "fp")
    large = rows.groupBy("start", "value").count().where(F.col("count") > part_rows)  # at most 5 * 8192 rows, whatever the input
    large = large.select("start", "value", F.ceil(F.col("count") * 2 / part_rows).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(large), ["start", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda o: F.struct(F.least(own, o).alias("p"), F.greatest(own, o).alias("q")))
    rows = rows.select("start", "value", F.explode(every).alias("pair"), "fp").select("start", "value", "pair.p", "pair.q", "fp")
    by = ["start", "value", "p", "q"]
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(tidy(_linker), "a long, b long")


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node it reaches) of every node of edges (a, b): large-star and small-star rounds until the stars stand still."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = materialise(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)
    raise RuntimeError("components did not settle")


class Hashes(dict):
    """64-bit hashes of words, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 1 << 18:
            self.clear()
        out = self[word] = xxh64_intdigest(word, 42)
        return out


def shingle_set(text: str | None, size: int, known: Hashes) -> np.ndarray:
    """The distinct hashes of a text's shingles, ASCII letters lowered, in order; a text shorter than a shingle is one."""
    words = (text or "").encode().lower().split()
    w = np.array(list(map(known.__getitem__, words)), np.uint64)
    size = min(size, len(w))
    if not size:
        return w
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(29)))


def bits_of(hashes: np.ndarray) -> tuple[int, int]:
    """The 128-bit SimHash of hashes as two signed longs."""
    if not len(hashes):
        return 0, 0
    out, h = [], hashes
    for _ in range(2):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out[0], out[1]


def n_keys(n: int, rare: int, similarity: float) -> int:
    """How many keys a set of n shingles needs, rare of them not known to be frequent.

    At most (1 / similarity - 1) * n of the shingles of two such sets are in one only, so that is the chance, through
    rare, of each of the first in their order; the first n - ceil(similarity * n) + 1 hold a common one for certain."""
    sure = n - int(np.ceil(similarity * n - 1e-9)) + 1
    chance = (1 / similarity - 1) * n / max(rare, 1)
    return min(sure, int(np.ceil(np.log(MISS) / np.log(chance)))) if 0 < chance < 1 else sure


def _keyer(size: int, similarity: float, known: np.ndarray, often: np.ndarray):
    """known: hashes in order that many texts hold, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        hashes = Hashes()
        for b in batches:
            node, n, bits, keys = [], [], [], []
            for t in b.column(1):
                own = shingle_set(t.as_py(), size, hashes)
                rank = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, often[at], 0)
                first = n_keys(len(own), int((rank == 0).sum()), similarity) if len(own) else 0
                node.append(np.uint64(xxh64_intdigest(own.tobytes())).astype(np.int64))
                n.append(len(own))
                bits.append(bits_of(own))
                keys.append(own[np.argsort(rank, kind="stable")][:first].view(np.int64))
            made = [pa.array(node, pa.int64()), pa.array(n, pa.int32()), *(pa.array([x[k] for x in bits], pa.int64()) for k in (0, 1)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], ["doc_id", "text_hash", "fp", "n", "bits", "more", "keys"])

    return run


def _setter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            sets = pa.array([shingle_set(t.as_py(), size, hashes).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["text_hash", "shingles"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], n_columns: int) -> Iterator[list[np.ndarray]]:
    """The columns behind the first three of each block of rows that come sorted by these; a block's rows may span batches."""
    held, block = [], None
    for b in batches:
        if not b.num_rows:
            continue
        h, p, q, *own = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3 + n_columns))
        new = np.flatnonzero((np.diff(h) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(h)]):
            this = (int(h[lo]), int(p[lo]), int(q[lo]))
            if this != block:
                if held:
                    yield [np.concatenate(x) for x in zip(*held)]
                held, block = [], this
            held.append(tuple(x[lo:hi].copy() for x in own))
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _edges(found: Iterator[tuple[np.ndarray, np.ndarray]], at_once: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    out, waiting = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]) if out else [], pa.int64()) for k in (0, 1)], ["a", "b"])

    for pair in found:
        out.append(pair)
        waiting += len(pair[0])
        if waiting > at_once:
            yield batch()
            out, waiting = [], 0
    yield batch()


def _spanned(fp: np.ndarray, n: np.ndarray, bits: np.ndarray, similarity: float, check=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest, as pairs (a, b), of the sets whose sizes and fingerprints, and check(i, others), let them pass. Rows come in rising order of n."""
    of, most = np.arange(len(fp)), np.searchsorted(n, n / similarity + 1e-9, side="right")
    for i in range(len(fp) - 1):
        other = np.flatnonzero(of[i + 1 : most[i]] != of[i]) + i + 1
        if not len(other):
            if (of == of[0]).all():
                return
            continue
        other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(1) <= WIDE]
        if check is not None and len(other):
            other = other[check(i, other)]
        if len(other):
            reached, first = np.unique(of[other], return_index=True)
            yield np.full(len(first), fp[i]), fp[other[first]]
            of[np.isin(of, reached)] = of[i]


def _clusterer(similarity: float):
    """Of each block of texts with a common key a forest of those that may be alike."""

    def of(fp: np.ndarray, n: np.ndarray, *bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.lexsort((fp, n))
        yield from _spanned(fp[order], n[order], np.stack(bits, 1)[order].view(np.uint64), similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _edges(x for columns in _blocks(batches, 4) if len(columns[0]) > 1 for x in of(*columns))

    return run


def _comparer(similarity: float):
    """Of each cluster, or two parts of it, a forest of the sets that are alike, by their exact similarity."""

    def of(fp: np.ndarray, sets: np.ndarray, *bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = np.array(list(map(len, sets)), np.int64)
        order = np.lexsort((fp, n))
        fp, n, bits = fp[order], n[order], np.stack(bits, 1)[order].view(np.uint64)
        ends = np.cumsum(n)
        values, numbers = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        mark = np.zeros(len(values), np.int32)

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            mine = numbers[ends[i] - n[i] : ends[i]]
            mark[mine] = 1
            both = np.array([mark[numbers[ends[j] - n[j] : ends[j]]].sum() for j in others])
            mark[mine] = 0
            return both / (n[i] + n[others] - both) >= similarity

        yield from _spanned(fp, n, bits, similarity, alike)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _edges(x for columns in _blocks(batches, 4) if len(columns[0]) > 1 for x in of(*columns))

    return run


def _held(batches: Iterator[pa.RecordBatch], size: int, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
    """The hashes of the shingle sets of a column of texts, some at a time."""
    hashes, held, waiting = Hashes(), [], 0
    for b in batches:
        for t in b.column(0):
            held.append(shingle_set(t.as_py(), size, hashes))
            waiting += len(held[-1])
            if waiting > at_once:
                yield np.concatenate(held)
                held, waiting = [], 0
    if waiting:
        yield np.concatenate(held)


def _bucket_counter(size: int):
    """Counts by the first bits of a hash, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for h in _held(batches, size):
            total += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        chunks = total.astype("<i8").reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunks[i].tobytes() for i in some], pa.binary())], ["chunk", "counts"])

    return run


def _bucket_adder(least: int):
    """Of each chunk the buckets that hold at least so many, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, counts in zip(b.column(0).to_pylist(), b.column(1)):
                total[i] = total.get(i, 0) + np.frombuffer(counts.as_py(), "<i8")
        packed = [np.packbits(x >= least).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "bits"])

    return run


def _counter(size: int, packed: np.ndarray):
    """Counts of the hashes in buckets whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.unpackbits(packed).view(bool)
        for h in _held(batches, size):
            values, counts = np.unique(h[full[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], ["h", "n"])

    return run


def frequent(texts: DataFrame, size: int, least: int) -> DataFrame:
    """h and n: the shingles that at least so many rows of the column of texts hold, each with the number of all that do.

    A first pass counts by the first bits of the hashes; what is in a bucket of fewer is no such shingle, and a second
    pass counts the others one by one. So all rows are counted, and few of their shingles are moved."""
    ship(texts.sparkSession)
    chunks = texts.mapInArrow(tidy(_bucket_counter(size)), "chunk int, counts binary").repartition("chunk")
    packed = np.zeros((1 << BUCKET_BITS) // 8, np.uint8)
    for r in chunks.mapInArrow(tidy(_bucket_adder(least)), "chunk int, bits binary").toArrow().to_pylist():  # a bit a bucket
        packed[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    counts = texts.mapInArrow(tidy(_counter(size, packed)), "h long, n long")
    return counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def similar_sets(docs: DataFrame, *, key: str, text: str, size: int, similarity: float, share: float = 7.5e-4, most: int = 100_000) -> DataFrame:
    """doc_id, text_hash, fp (a hash of the shingle set), n (its size), bits and more (its SimHash) and keys of every document.

    Keys are ordered by the counts, over all rows, of the shingles that such a share of them holds; of these most reach the
    driver, the most frequent. Any one order finds the same pairs; this one keeps what many texts hold out of the keys."""
    ship(docs.sparkSession)
    own = docs.select(F.col(named(key)).cast("long").alias("doc_id"), F.col(named(text)).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    least = max(3, int(np.ceil(share * own.count())))
    top = frequent(own.select("text"), size, least).orderBy(F.desc("n"), "h").limit(most).toArrow()  # bounded
    known, often = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(known)
    return own.mapInArrow(tidy(_keyer(size, similarity, known[order], often[order])), "doc_id long, text_hash long, fp long, n int, bits long, more long, keys array<long>")


def _in_parts(rows: DataFrame, counts: DataFrame, key: str, most: int) -> DataFrame:
    """rows with p and q: keys with more than most rows are dealt in parts, of which every two meet."""
    large = counts.where(F.col("count") > most).select(key, F.ceil(F.col("count") * 2 / most).cast("int").alias("parts"))
    large = materialise(large, "large")  # a row for every most rows at most
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    every = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(own, o).alias("p"), F.greatest(own, o).alias("q")))
    dealt = rows.join(large, key, "left").withColumn("_x", F.explode(every))
    by = [key, "p", "q"]
    return dealt.select(key, "_x.p", "_x.q", *(c for c in rows.columns if c != key)).repartition(*by).sortWithinPartitions(*by)


def similar_links(fps: DataFrame, docs: DataFrame, *, text: str, size: int, similarity: float, part_rows: int = 1 << 16, part_sets: int = 1 << 12) -> DataFrame:
    """Edges (a, b) between the sets of similar_sets that connect all that are at least so alike; every edge is such a pair."""
    nodes = materialise(fps.dropDuplicates(["fp"]).select("fp", "text_hash", "n", "bits", "more", "keys"), "sets")
    rows = nodes.select(F.explode("keys").alias("h"), "fp", "n", "bits", "more")
    maybe = _in_parts(rows, rows.groupBy("h").count(), "h", part_rows).mapInArrow(tidy(_clusterer(similarity)), "a long, b long")
    linked = components(maybe)  # a root is no node there
    clusters = linked.select(F.col("node").alias("fp"), F.col("root").alias("cluster")).unionByName(linked.select(F.col("root").alias("fp"), F.col("root").alias("cluster")).distinct())
    members = materialise(nodes.select("fp", "text_hash", "bits", "more").join(clusters, "fp"), "members")
    texts = docs.select(F.col(named(text)).cast("string").alias("text")).select(F.xxhash64("text").alias("text_hash"), "text")
    sets = only_in(texts, members, "text_hash").mapInArrow(tidy(_setter(size)), "text_hash long, shingles array<long>").dropDuplicates(["text_hash"])
    rows = sets.join(members, "text_hash").select("cluster", "fp", "shingles", "bits", "more")
    return _in_parts(rows, members.groupBy("cluster").count(), "cluster", part_sets).mapInArrow(tidy(_comparer(similarity)), "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, similarity: float | None = None, part_rows: int = 1 << 16) -> DataFrame:
    """doc_id, text_hash, fp, root (the smallest fingerprint that links reach) and component_id (the smallest doc_id there) of every document.

    With a similarity, fp is a hash of the shingle set, and links are the pairs at least so alike."""
    made = fingerprints(docs, key=key, text=text, size=size) if similarity is None else similar_sets(docs, key=key, text=text, size=size, similarity=similarity)
    fps = materialise(made, "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    if similarity is None:
        edges = near_links(nodes.select("fp"), part_rows=part_rows)
    else:
        edges = similar_links(fps, docs, text=text, size=size, similarity=similarity, part_rows=part_rows)
    roots = components(edges)
    rooted = materialise(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    of_root = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_nodes")), "roots")
    of = materialise(spread_join(rooted.select("fp", "n", "root"), of_root, "root", by="fp", n="n_nodes"), "components")
    return spread_join(fps.select("doc_id", "text_hash", "fp"), of, "fp", by="doc_id", n="n").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents, with all their columns, of which no near copy has a smaller id (among equal ids: text hash).

    Of rows with equal id and text one stays, that whose columns, written as JSON, come first. What goes is joined away;
    what stays is not moved while the list of what goes is small."""
    found = near_duplicates(docs, key=key, text=text, **how)

    def name(id_: Column, hashed: Column) -> Column:
        return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("-")), hashed)

    (mark,) = no_clash(docs, "mark")
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows = materialise(rows.select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("row"), "n"), "members")
    first = materialise(rows.groupBy("root").agg(F.min("row").alias("first"), F.count("*").alias("n_rows")).where("n_rows > 1"), "firsts")
    grouped = spread_join(rows, first, "root", by="row", n="n_rows").where(~F.col("row").eqNullSafe(F.col("first")))
    gone = grouped.select(name(F.col("row.doc_id"), F.col("row.text_hash")).alias(mark))
    lost = materialise(gone, "lost")
    repeated = rows.where("n > 1").select(name(F.col("row.doc_id"), F.col("row.text_hash")).alias(mark))
    repeated = materialise(repeated.join(lost, mark, "left_anti"), "repeated")
    gone = materialise(lost.unionByName(repeated), "gone")
    marked = docs.select(name(F.col(named(key)).cast("long"), F.xxhash64(F.col(named(text)).cast("string"))).alias(mark), F.struct(*columns_of(docs)).alias("row"))
    once = not_in(marked, gone, mark).select("row")
    several = only_in(marked, repeated, mark).groupBy(mark).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.unionByName(several).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
