"""From probabilities to matches: context features, one owner a candidate, thresholds, and macro F0.5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.config import pair_grid, single_grid
from kinlink.functions import text
from kinlink.operators.blocking import source_order

CONTEXT = ("p", "p_rank", "p_top1", "p_top2", "p_gap", "p_gap2", "n_ge05", "n_ge03", "p_sum", "p_share", "n_cands", "is_s3", "s3_best", "s2_best")


def context_features(scored: DataFrame, p: str = "p") -> DataFrame:
    """Adds CONTEXT to pairs (s1_id, cand_id, cand_pos, p): over the full list of an s1_id, before any pruning."""
    group = Window.partitionBy("s1_id")
    order = group.orderBy(F.col("p").desc(), "cand_pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = scored.withColumnRenamed(p, "p") if p != "p" else scored
    own = own.withColumn("is_s3", text.is_third_source(F.col("cand_id")).cast("double"))
    own = own.withColumns({
        "p_rank": F.row_number().over(order).cast("double"), "p_top1": F.max("p").over(group), "p_top2": F.coalesce(F.nth_value("p", 2).over(whole), F.lit(0.0)),
        "p_gap2": F.col("p") - F.lead("p", 1, 0.0).over(order), "n_ge05": F.count_if(F.col("p") >= 0.5).over(group).cast("double"),
        "n_ge03": F.count_if(F.col("p") >= 0.3).over(group).cast("double"), "p_sum": F.sum("p").over(group), "n_cands": F.count("*").over(group).cast("double"),
    })
    by_source = F.max("p").over(Window.partitionBy("s1_id", "is_s3"))
    own = own.withColumns({"p_gap": F.col("p_top1") - F.col("p"), "p_share": F.col("p") / F.greatest("p_sum", F.lit(1e-9)), "_best": (F.col("p") >= by_source).cast("double")})
    return own.withColumns({"s3_best": F.col("_best") * F.col("is_s3"), "s2_best": F.col("_best") * (1 - F.col("is_s3"))}).drop("_best")


def one_owner(scored: DataFrame, p: str = "p") -> DataFrame:
    """Each candidate stays with the s1_id that claims it best; the earlier record among equals. An aggregate, so a candidate that many claim is no hot task."""
    s1_order = [c.alias(f"o{i}") for i, c in enumerate(source_order("s1_id"))]
    best = scored.groupBy("cand_id").agg(F.min(F.struct((-F.col(p)).alias("worse"), *s1_order)).alias("best")).select("cand_id", F.col(f"best.o{len(s1_order) - 1}").alias("s1_id"))
    return scored.join(best, ["cand_id", "s1_id"], "left_semi")


def decode(scored: DataFrame, t_top: float, t_rest: float | None = None, p: str = "p") -> DataFrame:
    """The best pair of an s1_id from t_top on, any from t_rest on."""
    order = Window.partitionBy("s1_id").orderBy(F.col(p).desc(), "cand_pos")
    keep = ((F.col("_n") == 1) & (F.col(p) >= t_top)) | (F.col(p) >= (t_top if t_rest is None else t_rest))
    return scored.withColumn("_n", F.row_number().over(order)).where(keep).drop("_n")


def f05(hits: Column, predicted: Column, gold: Column) -> Column:
    """F0.5 of one entity from three counts."""
    precision, recall = hits / predicted, hits / gold
    return F.when(gold == 0, (predicted == 0).cast("double")).when(hits == 0, F.lit(0.0)).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def entity_f05(entities: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """s1_id, n_pred, n_gold, hits and f05 of every entity, those without pairs too."""
    marked = predicted.select("s1_id", "cand_id").distinct().withColumn("is_pred", F.lit(1)).join(gold.select("s1_id", "cand_id").distinct().withColumn("is_gold", F.lit(1)), ["s1_id", "cand_id"], "full")
    counts = marked.groupBy("s1_id").agg(F.count("is_pred").alias("n_pred"), F.count("is_gold").alias("n_gold"), F.count(F.col("is_pred") + F.col("is_gold")).alias("hits"))
    full = entities.select("s1_id").join(counts, "s1_id", "left").fillna(0, ["n_pred", "n_gold", "hits"])
    return full.withColumn("f05", f05(F.col("hits"), F.col("n_pred"), F.col("n_gold")))


def macro_f05(entities: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: the mean f05 of all entities."""
    return entity_f05(entities, predicted, gold).agg(F.avg("f05").alias("f05"), F.count("*").alias("n_entities"))


def threshold_grid(scored: DataFrame, entities: DataFrame, gold: DataFrame, grid: list[tuple[float, float]] | None = None, p: str = "p") -> DataFrame:
    """pos, t_top, t_rest, f05 of every setting, in one job: an entity's pairs are counted above each threshold, and the settings are sums over entities."""
    if grid is None:
        grid = [(t, t) for t in single_grid()] + pair_grid()
    order = Window.partitionBy("s1_id").orderBy(F.col(p).desc(), "cand_pos")
    of_gold = gold.select("s1_id", "cand_id").distinct().withColumn("_y", F.lit(1))
    ranked = scored.select("s1_id", "cand_id", F.col(p).alias("_p"), F.row_number().over(order).alias("_n")).join(of_gold, ["s1_id", "cand_id"], "left")
    rests = {t: i for i, t in enumerate(sorted({b for _, b in grid}))}
    first = F.col("_n") == 1
    above = [f(F.col("_p") >= t) for t, i in rests.items() for f in (lambda c, i=i: F.count_if(c).alias(f"n{i}"), lambda c, i=i: F.count_if(c & F.col("_y").isNotNull()).alias(f"h{i}"))]
    counts = ranked.groupBy("s1_id").agg(F.max(F.when(first, F.col("_p"))).alias("_best"), F.max(F.when(first, F.col("_y"))).alias("_hit"), *above)
    n_gold = entities.select("s1_id").join(of_gold.groupBy("s1_id").agg(F.count("*").alias("n_gold")), "s1_id", "left")
    full = n_gold.join(counts, "s1_id", "left").fillna(0)

    def mean(top: float, rest: float) -> Column:
        more = ((F.col("_best") >= top) & (F.col("_best") < rest)).cast("int")
        return F.avg(f05(F.col(f"h{rests[rest]}") + more * F.col("_hit"), F.col(f"n{rests[rest]}") + more, F.col("n_gold")))

    one = full.agg(*(mean(a, b).alias(f"f{i}") for i, (a, b) in enumerate(grid)))
    rows = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(float(a)).alias("t_top"), F.lit(float(b)).alias("t_rest"), F.col(f"f{i}").alias("f05")) for i, (a, b) in enumerate(grid)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def best_setting(grid: DataFrame) -> tuple[float, float, float]:
    """t_top, t_rest and f05 of the first of the best."""
    r = grid.orderBy(F.col("f05").desc(), "pos").first()
    return r.t_top, r.t_rest, r.f05


def match_lists(entities: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """source1_entity_id and its sorted ids, comma-joined, of every entity; empty if it has none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("cand_id")), ",").alias(column))
    full = entities.select("s1_id").join(lists, "s1_id", "left")
    return full.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))
