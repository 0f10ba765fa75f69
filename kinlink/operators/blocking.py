"""Candidate generation: blocking keys, a capped index with rarity weights, pair aggregates and a two-stage top-k cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.config import Config
from kinlink.functions import text
from kinlink.functions.indel import scored


def prepare(records: DataFrame) -> DataFrame:
    """entity_id, business_name, business_address, country to entity_id, name_n, core, addr_n, country_n, and the core's sound codes as one text."""
    named = records.select(
        "entity_id", text.normalize(F.col("business_name")).alias("name_n"), text.normalize(F.col("business_address")).alias("addr_n"), text.country(F.col("country")).alias("country_n")
    ).withColumn("core", text.core_name(F.col("name_n")))
    return named.select("entity_id", "name_n", "core", "addr_n", "country_n", F.array_join(text.phonetics(text.words(F.col("core"))), " ").alias("phon"))


def _tagged(tag: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(tag), *parts)


def _pairs(tokens: Column, tag: str, most: int) -> Column:
    """Every two of the first tokens, in alphabetical order."""
    first = F.slice(tokens, 1, most)
    return F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.lit(most)), lambda b: _tagged(tag, F.least(a, b), F.greatest(a, b)))))


def key_families() -> dict[str, Column]:
    """The families of keys as arrays, from t, p (tokens of the core and their sounds) and a (tokens of the address)."""
    t, p, a = F.col("t"), F.col("p"), F.col("a")
    none = F.array().cast("array<string>")
    n = F.size(t)

    def head(tokens: Column, i: int) -> Column:
        return F.left(F.get(tokens, F.lit(i)), F.lit(4))

    ordered = F.array_sort(t)
    joined = F.array_join(t, "")
    numbers = text.number_tokens(a)
    alpha = F.filter(a, lambda w: (F.length(w) >= 3) & text.is_alpha(w))
    sounds = text.phonetics(F.slice(alpha, 1, 7))
    beside = F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), F.get(a, i + 1).alias("y"))), lambda s: s["y"].isNotNull() & text.has_digit(s["x"]) & (F.length(s["y"]) >= 3) & text.is_alpha(s["y"]) & ~text.is_stop(s["y"]))
    return {
        "t": F.transform(F.filter(t, lambda w: F.length(w) >= 3), lambda w: _tagged("t", w)),
        "f": F.transform(F.filter(F.arrays_zip(t, p), lambda z: (F.length(z["t"]) >= 3) & (F.length(z["p"]) >= 2)), lambda z: _tagged("f", z["p"])),
        "pp": _pairs(p, "pp", 4),
        "p": F.when(n >= 2, F.array(_tagged("p", head(t, 0), head(t, 1)))).when(n == 1, F.array(_tagged("p", F.get(t, F.lit(0))))).otherwise(none),
        "s": F.when(n >= 2, F.array(_tagged("s", head(ordered, 0), head(ordered, 1)))).otherwise(none),
        "cat": F.when(F.length(joined) >= 5, F.array(_tagged("cat", text.phonetic(F.left(joined, F.lit(12)))))).otherwise(none),
        "d": F.transform(F.filter(numbers, lambda x: F.length(x) >= 3), lambda x: _tagged("d", x, F.coalesce(F.left(F.get(t, F.lit(0)), F.lit(3)), F.lit("")))),
        "nn": _pairs(numbers, "nn", 5),
        "nw": F.zip_with(F.transform(beside, lambda s: text.number(s["x"])), text.phonetics(F.transform(beside, lambda s: s["y"])), lambda x, y: _tagged("nw", x, y)),
        "at": F.transform(text.phonetics(text.rare_words(a)), lambda w: _tagged("at", w)),
        "ap": F.zip_with(F.slice(sounds, F.lit(1), F.greatest(F.size(sounds) - 1, F.lit(0))), F.slice(sounds, F.lit(2), F.size(sounds)), lambda x, y: _tagged("ap", x, y)),
    }


def blocking_keys(prepared: DataFrame, families: tuple[str, ...] | None = None) -> DataFrame:
    """entity_id and its distinct keys, one a row."""
    made = key_families()
    split = prepared.select("entity_id", "country_n", text.words(F.col("core")).alias("t"), text.words(F.col("phon")).alias("p"), text.words(F.col("addr_n")).alias("a"))
    keys = F.array_distinct(F.concat(*(made[f] for f in families or made)))
    return split.select("entity_id", "country_n", F.explode(keys).alias("k")).select("entity_id", F.concat_ws("|", "country_n", "k").alias("key"))


def block_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("block_size"))


def build_index(keys: DataFrame, config: Config = Config()) -> DataFrame:
    """cand_id, key, block_size, w of the keys that at most max_block records share; w is their rarity."""
    sizes = block_sizes(keys).where(F.col("block_size") <= config.max_block)
    weight = F.log1p(F.lit(float(config.max_block)) / F.col("block_size")).cast("float")
    return keys.withColumnRenamed("entity_id", "cand_id").join(sizes, "key").select("cand_id", "key", "block_size", weight.alias("w"))


def pair_counts(s1_keys: DataFrame, index: DataFrame) -> DataFrame:
    """s1_id, cand_id, shared_keys and key_idf (their summed rarity) of all pairs that share a key. A key meets at most max_block candidates.

    Pairs move once, to the task of their s1_id, where a later cut finds them; few of them would merge before."""
    met = s1_keys.withColumnRenamed("entity_id", "s1_id").join(index, "key").select("s1_id", "cand_id", "w").repartition("s1_id")
    return met.groupBy("s1_id", "cand_id").agg(F.count("*").alias("shared_keys"), F.sum(F.col("w").cast("double")).cast("float").alias("key_idf"))


def source_order(entity_id: str) -> list[Column]:
    """The order of records in their sources: by source, then by number."""
    return [F.left(F.col(entity_id), F.lit(2)), F.substring_index(entity_id, "-", -1).cast("long"), F.col(entity_id)]


def cut(pairs: DataFrame, score: Column, k: int, *ties: Column, rank: str = "cand_pos") -> DataFrame:
    """The k best pairs of each s1_id; Spark ranks within map tasks first, so a shuffle carries at most k a group and task."""
    w = Window.partitionBy("s1_id").orderBy(score.desc(), *ties)
    return pairs.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def candidate_pairs(s1_keys: DataFrame, index: DataFrame, config: Config = Config()) -> DataFrame:
    """The pre_k pairs of each s1_id with the highest key_idf."""
    return cut(pair_counts(s1_keys, index), F.col("key_idf"), config.pre_k, *source_order("cand_id"))


STRINGS = ("name_n", "core", "addr_n", "phon")


def with_strings(pairs: DataFrame, s1: DataFrame, others: DataFrame) -> DataFrame:
    """The prepared strings of both records, as a_ and b_ columns: only ids travel before the first cut.

    Those of s1_id come last, so that they never travel with pairs and what ranks within an s1_id finds its pairs in one task."""
    a = s1.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"a_{c}") for c in STRINGS))
    b = others.select(F.col("entity_id").alias("cand_id"), *(F.col(c).alias(f"b_{c}") for c in STRINGS))
    return pairs.join(b, "cand_id").join(a, "s1_id")


def rank_candidates(pairs: DataFrame, s1: DataFrame, others: DataFrame, config: Config = Config()) -> DataFrame:
    """The top_k pairs by rarity plus likeness of names and addresses, with the strings; a missing name counts as neutral."""
    wide = with_strings(pairs, s1, others)
    alike = wide.withColumns({"name_tset": scored("token_set_ratio", F.col("a_name_n"), F.col("b_name_n")), "addr_tset": scored("token_set_ratio", F.col("a_addr_n"), F.col("b_addr_n"))})
    name = F.when((F.col("a_core") == "") | (F.col("b_core") == ""), F.lit(config.neutral)).otherwise(F.col("name_tset"))
    score = F.col("key_idf") + ((name + F.col("addr_tset")) / 100).cast("float")
    return cut(alike.withColumnRenamed("cand_pos", "pre_pos"), score, config.top_k, F.col("pre_pos")).drop("pre_pos")
