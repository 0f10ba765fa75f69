"""Quality rules: a decision list learned by sequential covering.

Statistics of every whole text are counted in one pass without a shuffle. From the statistics of labelled documents
the learner grows one rule at a time: threshold conditions are added while they gain information about the rejected
class (FOIL's gain), then dropped from the end while that serves a held-out part (incremental reduced error pruning).
A rule is kept if it is precise there; what it covers is taken away and the next is grown. The list becomes one
ordered Spark conditional expression over the statistics.

The fit takes at most `sample` labelled documents, those with the smallest id hashes; everything else covers all rows.

Defined results: a null text has no words. Null or repeated labels: nulls are left out, and an id's smallest quality
counts. With no labels, or none of one class, the list is empty and keeps all. Repeated rows get equal verdicts. An
empty table gives no rows. Other columns are ignored by the query and carried along by the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import columns_of, give_back, named, no_clash, ship, table, tidy

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echoes", "n_upper", "n_digits", "n_marks", "longest_word", "n_edge_symbols")


def repeated_words(ids: np.ndarray, size: int = 5) -> int:
    """How many words stand in a window of size words that is found twice or more."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    two = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)[1]
    _, which, count = np.unique(four[:n] * (ids.max() + 1) + ids[4 : 4 + n], return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[which] > 1)
    if not len(at):
        return 0
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text. A word is a run of characters other than ASCII blanks."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen: set[bytes] = set()
    lines = repeats = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            repeats += line in seen
            seen.add(line)
    repeated = repeated_words(ids) if 5 < len(words) and len(number) < len(words) else 0
    distinct = list(number)
    return (
        len(words), len(text) - (len(raw) - len(raw.translate(None, BLANKS))), len(raw) - len(raw.translate(None, SYMBOLS)), repeats, repeated, lines, int((ids[1:] == ids[:-1]).sum()),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(raw) - len(raw.translate(None, b"0123456789")), len(raw) - len(raw.translate(None, b".,;:!?")),
        max(map(len, distinct), default=0), sum(w[-1] in SYMBOLS or w[-1] == 33 for w in words),
    )


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", *COUNTS]
    for b in batches:
        rows = [statistics(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS)))], names)


def count_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and COUNTS of every document."""
    ship(docs.sparkSession)
    own = docs.select(F.col(named(key)).cast("long").alias("key"), F.col(named(text)).cast("string").alias("text"))
    return own.mapInArrow(tidy(_counter), "key long, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """What conditions are about, from COUNTS."""

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "echo_share": share("n_echoes", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "n_words"),
        "words_a_line": share("n_words", "n_lines"),
        "edge_symbol_share": share("n_edge_symbols", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] >= F.lit(self.threshold) if self.at_least else f[self.feature] <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _cuts(values: np.ndarray, bad: np.ndarray, steps: int) -> np.ndarray:
    """Midpoints between neighbours among quantiles of all values and of the rejected class's."""
    q = np.linspace(0, 1, steps)
    seen = np.unique(np.concatenate([np.quantile(values, q), np.quantile(bad, q) if len(bad) else []]))
    return (seen[:-1] + seen[1:]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int, steps: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < longest:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for f, values in x.items():
            v, b = values[inside], bad[inside]
            for cut in _cuts(v, v[b], steps):
                for at_least in (True, False):
                    hit = v >= cut if at_least else v <= cut
                    p = int((hit & b).sum())
                    if not p:
                        continue
                    n = int(hit.sum()) - p
                    g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if g > gain:
                        best, gain = Condition(f, at_least, float(cut)), g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        hit = covers(r, x, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, *, longest: int = 3, most: int = 16, steps: int = 24, precision: float = 0.9, support: int = 3) -> list[Rule]:
    """Ordered rules that reject. fold: rows that grow rules are True, the others prune and judge them."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most:
        g, h = left & fold, left & ~fold
        if (bad & g).sum() < support:
            break
        xg, xh = ({f: v[m] for f, v in x.items()} for m in (g, h))
        rule = _grow(xg, bad[g], longest, steps)
        if not rule:
            break
        rule = _prune(rule, xh, bad[h])
        hit, held = covers(rule, x, len(bad)) & left, covers(rule, xh, int(h.sum()))
        p = int((hit & bad).sum())
        if p < support or p < precision * hit.sum() or (held.any() and bad[h][held].mean() < precision):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 20_000, **how) -> list[Rule]:
    """The decision list for the labelled documents that pass base_failed. Conditions are about shares and means, and about the number of words. Only their numbers reach the driver, at most sample rows."""
    good = labels.where(F.col(named(label)).isNotNull() & F.col(named(key)).isNotNull()).groupBy(F.col(named(key)).cast("long").alias("key")).agg(F.min(F.col(named(label))).alias("good"))
    good = good.orderBy(F.xxhash64("key"), "key").limit(sample)  # the documented bound; so it is small enough to broadcast
    own = docs.select(F.col(named(key)).cast("long").alias("key"), F.col(named(text)).alias("text")).join(F.broadcast(good.select("key")), "key", "left_semi")
    counted = count_statistics(own, "key", "text").where(~base_failed()).join(F.broadcast(good), "key")
    rows = counted.select("key", "good", *(c.alias(n) for n, c in features().items())).groupBy("key").agg(F.first("good").alias("good"), *(F.min(n).alias(n) for n in features())).orderBy("key").toPandas()
    if not len(rows):
        return []
    bad, key_hash = (rows["good"] == 0).to_numpy(), rows["key"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return learn({n: rows[n].to_numpy(float) for n in features()}, bad, (key_hash >> np.uint64(32)) % np.uint64(3) != 0, **how)


def verdict(rules: list[Rule]) -> Column:
    """Which rule rejects, from 1; 0 if none does. One ordered conditional expression over COUNTS."""
    f = features()
    out = F
    for i, rule in enumerate(rules):
        condition = rule[0].column(f)
        for c in rule[1:]:
            condition = condition & c.column(f)
        out = out.when(condition, F.lit(i + 1))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, COUNTS, base_failed, rule (the first that rejects, 0: none) and kept of every document."""
    return count_statistics(docs, key, text).withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns, in one pass without a shuffle."""
    ship(docs.sparkSession)
    (mark,) = no_clash(docs, "counts")
    count = F.arrow_udf(_count_column, "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    marked = docs.withColumn(mark, count(F.col(named(text)).cast("string")))
    opened = marked.select(*(F.col(f"`{mark}`.{c}").alias(c) for c in COUNTS), F.struct(*columns_of(docs)).alias("row"))
    return opened.where(~base_failed() & (verdict(rules) == 0)).select("row.*")


def _count_column(texts: pa.Array) -> pa.Array:
    rows = [statistics(t.as_py()) for t in texts]
    give_back()
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))], list(COUNTS))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
