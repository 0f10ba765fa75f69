"""Benchmark decontamination, in DataFrame operations only.

A document leaks an item if one of its windows of as many words as the item has is at least `similarity` alike: the
weighted Jaccard similarity of their multisets of word shingles, each weighed by how often it stands there. Of each
document and item the best window counts, the first among equals.

1. Places. A Bloom filter of the items' shingles, sized by their number, sifts the places of a text in the scan; a join
   makes them exact. Windows so alike share at least 2 m similarity / (1 + similarity) of their m shingles. Moving a
   window along, an occurrence of a shingle counts from where it enters, or from where the one that many of the item's
   occurrences before it leaves, to where it leaves itself: an interval of starts. A running sum over the intervals' ends
   tells of every window of a text, in time linear in its places, how much it shares, whatever the order; the best
   window of an item goes on if it shares enough.
2. SimHash. A window's features are its shingles, numbered where they repeat, so that their sets are as alike as the
   multisets. Their fingerprint has `LONGS` * `BLOCKS` blocks of `BLOCK_BITS` bits, 240 bits in all. Equal windows,
   in whatever documents, are fingerprinted and looked up once.
3. Multi-index Hamming blocks. If two fingerprints differ in at most `RADIUS` (59) bits, one of the 20 blocks differs in
   at most 2; items stand in the index under every block value within 2 bits, so an equi-join on (length, block,
   value) finds every pair within the radius. A block's values are 79 of 4096, and the full check lets through what lies
   within 59 of 240 bits, where texts without common shingles are 120 bits apart, give or take 8.
4. The exact similarity of the features verifies the candidates.

At similarity 0.8 fingerprints differ in about 36 bits, give or take 6, so radius 59 is four deviations away; what is
more alike is nearer. Tables of items are broadcast only where their size is counted to be small; beyond that they are
shuffled, and what is met often is spread. Nothing is gathered but one document's own places of one item.

Defined results: an item of fewer words than a shingle is one shingle of all its words, found where they stand one
after another; an item without words is never found. A document of fewer words than the item is one window as a whole;
n_words counts the window's words. Null and empty texts leak nothing. Items with equal texts are found together. Rows of
equal id count together; a null doc_id is an id. Repeated rows give one result. With no items nothing leaks. An empty
table gives no rows. Other columns are ignored by the search and carried along by the filter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.common import Sieve, columns_of, materialise, named, no_clash, not_in, table

SIZE, SIMILARITY = 5, 0.8
LONGS, BLOCKS, BLOCK_BITS, RADIUS = 4, 5, 12, 59  # BLOCKS a long
NEAR = RADIUS // (LONGS * BLOCKS)
MOST_BROADCAST = 8 << 20  # bytes
SPREAD = 16
BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII blanks, ASCII letters lowered."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, BLANK), lambda w: w != "")


def shingles(w: str, size: int) -> Column:
    """The 64-bit hashes of the shingles of a column of words, in their order."""

    def at(word: Column, i: Column) -> Column:
        return F.xxhash64(word, *(F.get(F.col(w), i + k) for k in range(1, size)))

    return F.when(F.size(w) >= size, F.transform(F.slice(w, F.lit(1), F.size(w) - (size - 1)), at)).otherwise(F.array().cast("array<bigint>"))


def shingles_of(w: str, size: Column, sizes: list[int]) -> Column:
    """shingles with a size of each row, one of sizes."""
    out = F
    for k in sizes:
        out = out.when(size == k, shingles(w, k))
    return out.otherwise(F.array().cast("array<bigint>"))


def features(hashes: str) -> Column:
    """The distinct hashes of a sorted column's values, each with its number among equal ones."""
    h = F.col(hashes)

    def one(x: Column, i: Column) -> Column:
        again = F.get(h, i - 1) == x
        return F.xxhash64(x, F.when(again, i + 1 - F.array_position(h, x).cast("int")).otherwise(0))

    return F.transform(h, one)


def fingerprint(of: str) -> Column:
    """LONGS longs of BLOCKS * BLOCK_BITS bits, each set if it is in over half of the hashes that the features give.

    Sixteen sums a long hold four counters of 16 bits each; more than 65,535 features are counted bit by bit. Written as
    SQL, for it is one call of the engine where columns would take some thousands."""
    last, bit = BLOCKS * BLOCK_BITS - 1, "IF(2 * {} > size({}), shiftleft(1L, b), 0L)"
    fast = f"""aggregate(transform({of}, x -> xxhash64(x, k)), array_repeat(0L, 16), (s, x) -> zip_with(s, sequence(0, 15), (v, i) -> v + (shiftrightunsigned(x, i) & {0x0001000100010001}L)),
        s -> aggregate(sequence(0, {last}), 0L, (out, b) -> out | {bit.format("(shiftrightunsigned(s[b % 16], 16 * CAST(b DIV 16 AS INT)) & 65535)", of)}))"""
    slow = f"aggregate(sequence(0, {last}), 0L, (out, b) -> out | {bit.format(f'aggregate({of}, 0, (n, x) -> n + getbit(xxhash64(x, k), b))', of)})"
    return F.expr(f"transform(sequence(0, {LONGS - 1}), k -> IF(size({of}) < 65536, {fast}, {slow}))")


def alike(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two arrays of distinct values."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _met(many: DataFrame, one: DataFrame, keys: list[str], by: str, rows: int, width: int) -> DataFrame:
    """many joined with one, of so many rows of so many bytes: broadcast if that is small, else shuffled, with each key of many spread over tasks by a column."""
    if rows * width <= MOST_BROADCAST:
        return many.join(F.broadcast(one), keys)
    spread = many.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SPREAD)))
    return spread.join(one.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint")))), [*keys, "_part"]).drop("_part")


def item_features(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """item_id, item (equal for equal shingles), n_words, size (of its shingles), hashes (sorted) and features of the items that have a word."""
    own = items.select(F.col(named(key)).cast("long").alias("item_id"), words(F.col(named(text)).cast("string")).alias("w")).withColumn("n_words", F.size("w"))
    own = own.where(F.col("n_words") > 0).withColumn("size", F.least("n_words", F.lit(size)))
    own = own.withColumn("hashes", F.sort_array(shingles_of("w", F.col("size"), list(range(1, size + 1)))))
    return own.select("item_id", F.xxhash64("n_words", "hashes").alias("item"), "n_words", "size", "hashes").withColumn("features", features("hashes"))


def _block(fp: str) -> str:
    return f"CAST(shiftrightunsigned({fp}[CAST(b DIV {BLOCKS} AS INT)], {BLOCK_BITS} * (b % {BLOCKS})) & {(1 << BLOCK_BITS) - 1} AS INT)"


def blocks(fp: str) -> Column:
    """(block, value) of a fingerprint."""
    return F.expr(f"transform(sequence(0, {LONGS * BLOCKS - 1}), b -> named_struct('block', b, 'value', {_block(fp)}))")


def variants(fp: str) -> Column:
    """(block, value) of every block value within NEAR bits of a fingerprint's."""
    flips = [sum(1 << i for i in c) for k in range(NEAR + 1) for c in combinations(range(BLOCK_BITS), k)]
    return F.flatten(F.transform(blocks(fp), lambda x: F.transform(F.split(F.lit(",".join(map(str, flips))), ",").cast("array<int>"), lambda f: F.struct(x["block"].alias("block"), x["value"].bitwiseXOR(f).alias("value")))))


def differing(a: str, b: str) -> Column:
    """The bits in which two fingerprints differ."""
    return F.expr(" + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(LONGS)))


def _first_block(a: str, b: str) -> Column:
    """The first block in which two fingerprints are within NEAR bits."""
    return F.expr(f"array_position(transform(sequence(0, {LONGS * BLOCKS - 1}), b -> bit_count({_block(a)} ^ {_block(b)}) <= {NEAR}), true) - 1")


def best_windows(held: DataFrame, similarity: float) -> DataFrame:
    """row, start, n_words and size of the first of the windows that share most with an item, if that is enough. held: row, n_doc, item, n_words, size, place, h and c (the item's count of h) of every place that holds a shingle of an item."""
    whole = ["row", "n_doc", "item", "n_words", "size"]
    of_window, of_item = F.least("n_words", "n_doc") - F.col("size") + 1, F.col("n_words") - F.col("size") + 1
    need = F.greatest(F.ceil((of_window + of_item) * (similarity / (1 + similarity)) - 1e-6), F.lit(1))
    got = held.groupBy(*whole).agg(F.sort_array(F.collect_list(F.struct("h", "place", "c"))).alias("a")).withColumn("need", need).where(F.size("a") >= F.col("need"))

    def span(x: Column, i: Column) -> Column:
        before = F.get(F.col("a"), i - x["c"])
        out = F.when(before["h"] == x["h"], before["place"] + 1).otherwise(0)
        return F.struct(F.greatest(out, x["place"] - of_window + 1, F.lit(0)).alias("lo"), F.least(x["place"], F.greatest(F.col("n_doc") - F.col("n_words"), F.lit(0))).alias("hi"))

    spans = got.select(*whole, "need", F.explode(F.transform("a", span)).alias("x")).where("x.lo <= x.hi")
    ends = spans.select(*whole, "need", F.explode(F.array(F.struct(F.col("x.lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("x.hi") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*whole, "need", "e.at").agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*whole, "need").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # one document's places of one item
    shared = steps.withColumn("n", F.sum("d").over(order)).where("n >= need")
    return shared.groupBy(*whole).agg(F.max(F.struct("n", (-F.col("at")).alias("at"))).alias("best")).select("row", (-F.col("best.at")).alias("start"), "n_words", "size").distinct()


def leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity (of the most similar window), first_word (its start, the first if there are more), n_words, differing_bits of every leak."""
    own_items = materialise(item_features(items, item_key, item_text, size), "items")
    unique = own_items.dropDuplicates(["item"])
    placed = unique.select("item", "n_words", "size", F.explode("hashes").alias("h")).groupBy("item", "n_words", "size", "h").agg(F.count("*").cast("int").alias("c"))
    n_placed = placed.count()
    sizes = [r[0] for r in own_items.select("size").distinct().orderBy(F.desc("size")).collect()] or [size]  # at most size rows
    sieve = Sieve(placed.select("h"), n_placed)

    def hits(k: int) -> Column:
        return F.filter(F.transform(F.col(f"s{k}"), lambda h, i: F.struct(i.alias("place"), h.alias("h"))), lambda x: sieve.may_hold(x["h"]))

    # the row number, not being deterministic, also keeps the optimizer from moving the words' split into what follows
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(named(key)).cast("long").alias("doc_id"), words(F.col(named(text)).cast("string")).alias("w"))
    sifted = split.where(F.size("w") >= sizes[-1]).select("*", *(shingles("w", k).alias(f"s{k}") for k in sizes))
    sifted = sifted.select("row", "doc_id", "w", F.concat(*map(hits, sizes)).alias("hits")).where(F.size("hits") > 0)
    found = materialise(sifted, "anchored")  # written, so rows keep their numbers

    anchors = found.select("row", F.size("w").alias("n_doc"), F.explode("hits").alias("x")).select("row", "n_doc", "x.place", "x.h")
    best = best_windows(_met(anchors, placed, ["h"], "row", n_placed, 48), similarity)
    starts = best.groupBy("row").agg(F.collect_list(F.struct("start", "n_words", "size")).alias("starts"))  # one document's leaks
    starts = materialise(starts, "starts")  # so that texts are not moved while there are few
    windows = found.join(starts, "row").select("row", "doc_id", "w", F.explode("starts").alias("x"))
    windows = windows.select("row", "doc_id", "x.start", "x.n_words", "x.size", F.slice("w", F.col("x.start") + 1, F.col("x.n_words")).alias("own"))
    windows = windows.select("row", "doc_id", "start", "n_words", F.size("own").alias("n_own"), F.sort_array(shingles_of("own", F.col("size"), sizes)).alias("hashes"))
    windows = materialise(windows.withColumn("window", F.xxhash64("n_words", "n_own", "hashes")), "windows")

    printed = windows.dropDuplicates(["window"]).select("window", "n_words", "hashes").withColumn("features", features("hashes")).drop("hashes")
    printed = materialise(printed.withColumn("fp", fingerprint("features")), "fingerprints")
    known = materialise(unique.select("item", "n_words", "features").withColumn("item_fp", fingerprint("features")), "item-fingerprints")
    index = known.select("item", "n_words", "item_fp", F.explode(variants("item_fp")).alias("v")).select("item", "n_words", "item_fp", "v.block", "v.value")
    probes = printed.select("window", "n_words", "fp", F.explode(blocks("fp")).alias("v")).select("window", "n_words", "fp", "v.block", "v.value")
    apart = differing("fp", "item_fp")
    pairs = probes.join(index.hint("merge"), ["n_words", "block", "value"])  # windows are distinct here; a hint, for the index is larger than it looks
    # a pair that meets in several blocks counts in one
    pairs = pairs.where((apart <= RADIUS) & (_first_block("fp", "item_fp") == F.col("block"))).select("window", "item", apart.alias("differing_bits"))
    full = pairs.join(printed.select("window", F.col("features").alias("a")), "window").join(known.select("item", F.col("features").alias("b")), "item")
    verified = full.select("window", "item", "differing_bits", alike(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= similarity)
    verified = materialise(verified.join(own_items.select("item", "item_id"), "item").drop("item"), "verified")
    leaking = _met(windows.drop("hashes"), verified, ["window"], "row", verified.count(), 40)
    top = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "differing_bits", "n_own"))
    return leaking.groupBy("doc_id", "item_id").agg(top.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.s")).alias("similarity"), F.col("b.start").alias("first_word"), F.col("b.n_own").alias("n_words"), F.col("b.differing_bits")
    )


def without_leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents, with all their columns, that leak no item; rows are told apart by id and text hash."""
    (mark,) = no_clash(docs, "mark")
    name = F.xxhash64(F.coalesce(F.col(named(key)).cast("long").cast("string"), F.lit("-")), F.coalesce(F.col(named(text)).cast("string"), F.lit("")))
    marked = docs.withColumn(mark, name)
    found = materialise(leaks(marked, items, key=mark, text=text, **how).select(F.col("doc_id").alias(mark)).distinct(), "leaking")
    return not_in(marked, found, mark).select(*columns_of(docs))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("differing_bits")


# Every window of every text that shares a shingle with an item, counted one by one.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
sized AS (SELECT *, len(w) AS n, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
i_s AS (SELECT item_id, n, k, array_to_string(w[p:p + k - 1], ' ') AS s, count(*) AS c FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM sized) GROUP BY ALL),
d_s AS (SELECT r, len(w) AS m, k, p - 1 AS pos, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM sized))),
met AS (SELECT r, m, item_id, n, k, pos, s, c, least(n, m) - k + 1 AS wide FROM d_s JOIN i_s USING (k, s)),
held AS (SELECT r, m, item_id, n, k, s, c, wide, unnest(range(greatest(pos - wide + 1, 0), least(pos, greatest(m - n, 0)) + 1)) AS start FROM met),
summed AS (SELECT r, item_id, n, m, start, wide, k, sum(least(x, c)) AS shared FROM (SELECT r, m, item_id, n, k, s, c, wide, start, count(*) AS x FROM held GROUP BY ALL) GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, least(n, m) AS n_words, shared / (wide + n - k + 1 - shared) AS similarity FROM summed JOIN d USING (r))
SELECT doc_id, item_id, similarity, start AS first_word, n_words FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start, n_words) = 1
"""
