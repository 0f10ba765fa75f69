"""How good candidates and decisions are, against gold pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.config import Config
from kinlink.operators import decide
from kinlink.operators.blocking import block_sizes


def _marked(gold: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    return gold.join(pairs.select("s1_id", "cand_id").distinct().withColumn(name, F.lit(1)), ["s1_id", "cand_id"], "left")


def blocking_recall(pairs: DataFrame, entities: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: gold pairs, those found, recall, pairs and pairs an entity."""
    found = _marked(gold.select("s1_id", "cand_id").distinct(), pairs, "hit").agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_found"))
    n = pairs.agg(F.count("*").alias("n_pairs")).join(F.broadcast(entities.agg(F.count("*").alias("n_entities"))))
    one = found.join(F.broadcast(n))  # single rows
    return one.withColumns({"recall": F.col("n_found") / F.greatest("n_gold", F.lit(1)), "pairs_each": F.col("n_pairs") / F.greatest("n_entities", F.lit(1))})


def f05_ceiling(pairs: DataFrame, entities: DataFrame, gold: DataFrame) -> DataFrame:
    """macro F0.5 of a perfect model: all gold pairs among the candidates, nothing else."""
    return decide.macro_f05(entities, pairs.join(gold.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_semi"), gold)


def all_empty_floor(entities: DataFrame, gold: DataFrame) -> DataFrame:
    """macro F0.5 of predicting nothing."""
    return decide.macro_f05(entities, gold.select("s1_id", "cand_id").limit(0), gold)


def miss_classes(gold: DataFrame, s1_keys: DataFrame, other_keys: DataFrame, ranked: DataFrame, config: Config = Config()) -> DataFrame:
    """status and n of the gold pairs: found, cut by ranking, key too frequent, or no shared key.

    Only the gold pairs' own keys are compared, so nothing here grows with the square of a block."""
    pairs = gold.select("s1_id", "cand_id").distinct()
    sizes = block_sizes(other_keys)
    mine = pairs.join(s1_keys.withColumnRenamed("entity_id", "s1_id"), "s1_id")
    shared = mine.join(other_keys.withColumnRenamed("entity_id", "cand_id"), ["cand_id", "key"]).join(sizes, "key")
    least = shared.groupBy("s1_id", "cand_id").agg(F.min("block_size").alias("least"))
    full = _marked(pairs, ranked, "hit").join(least, ["s1_id", "cand_id"], "left")
    status = F.when(F.col("hit").isNotNull(), "found").when(F.col("least").isNull(), "no shared key").when(F.col("least") > config.max_block, "key too frequent").otherwise("cut by ranking")
    return full.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def pruning_curve(scored: DataFrame, entities: DataFrame, gold: DataFrame, config: Config = Config(), p: str = "p") -> DataFrame:
    """tau, candidates an entity and recall of cutting the scored pairs at each tau, in one pass."""
    of_gold = gold.select("s1_id", "cand_id").distinct().withColumn("_y", F.lit(1))
    taus = F.array(*map(F.lit, config.taus))
    kept = scored.select("s1_id", "cand_id", p).join(of_gold, ["s1_id", "cand_id"], "left").select("_y", F.explode(F.filter(taus, lambda t: F.col(p) >= t)).alias("tau"))
    counts = kept.groupBy("tau").agg(F.count("*").alias("n_pairs"), F.count("_y").alias("n_found"))
    sizes = entities.agg(F.count("*").alias("n")).join(F.broadcast(of_gold.agg(F.count("*").alias("g"))))
    joined = counts.join(F.broadcast(sizes))  # a row a tau beside a single row
    return joined.select("tau", (F.col("n_pairs") / F.col("n")).alias("pairs_each"), (F.col("n_found") / F.greatest("g", F.lit(1))).alias("recall"))


def country_counts(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("country_n").agg(F.count("*").alias("n"))


def claim_counts(claims: DataFrame, owned: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: claims that one_owner removed, and entities without a match."""
    removed = claims.agg(F.count("*").alias("n_claims")).join(F.broadcast(owned.agg(F.count("*").alias("n_owned"))))
    empty = entities.select("s1_id").join(owned.select("s1_id").distinct(), "s1_id", "left_anti").agg(F.count("*").alias("n_empty"))
    return removed.join(F.broadcast(empty)).select((F.col("n_claims") - F.col("n_owned")).alias("n_removed"), "n_empty")  # single rows
