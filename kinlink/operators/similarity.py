"""The 36 features of a candidate pair: 28 of its two records, 8 of its place among the pairs of its s1_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions import text
from kinlink.functions.indel import scored
from kinlink.functions.shared import NAMES as SHARED
from kinlink.functions.shared import shared

FEATURES = (
    "shared_keys", "key_idf", "name_ratio", "name_tsort", "name_tset", "name_partial", "core_ratio", "core_tset", "addr_ratio", "addr_tset",
    "addr_partial", "name_jacc", "digit_jacc", "digit_any", "first_tok_eq", "len_diff", "phon_tset", "phon_ratio", "phon_first_eq",
    "core_partial", "nospace_ratio", "acronym_eq", "name_empty", "addr_rare_shared", "num_shared", "addr_contain", "name_contain", "is_s3",
    "rank_name", "rank_addr", "idf_rank", "name_gap", "addr_gap", "phon_gap", "idf_gap", "n_cands",
)


def token_features(wide: DataFrame) -> DataFrame:
    """Adds the features that need no edit distance, to pairs with strings; all but the source by one Python pass."""
    found = shared(*(F.col(f"{s}_{c}") for c in ("core", "addr_n", "phon") for s in "ab"))
    with_found = wide.withColumn("_shared", found)
    return with_found.withColumns({n: F.col("_shared")[n] for n in SHARED} | {"is_s3": text.is_third_source(F.col("cand_id")).cast("double")}).drop("_shared")


def edit_features(wide: DataFrame) -> DataFrame:
    """Adds the features by edit distance; all their scorers run in one Python pass."""
    flat = {s: F.replace(F.col(f"{s}_core"), F.lit(" "), F.lit("")) for s in "ab"}
    plan = {
        "name_ratio": ("ratio", "name_n"), "name_tsort": ("token_sort_ratio", "name_n"), "name_partial": ("partial_ratio", "name_n"),
        "core_ratio": ("ratio", "core"), "core_tset": ("token_set_ratio", "core"), "core_partial": ("partial_ratio", "core"),
        "addr_ratio": ("ratio", "addr_n"), "addr_partial": ("partial_ratio", "addr_n"),
        "phon_tset": ("token_set_ratio", "phon"), "phon_ratio": ("ratio", "phon"),
    }
    made = {f: scored(kind, F.col(f"a_{c}"), F.col(f"b_{c}")) for f, (kind, c) in plan.items()}
    for f, c in (("name_tset", "name_n"), ("addr_tset", "addr_n")):
        if f not in wide.columns:
            made[f] = scored("token_set_ratio", F.col(f"a_{c}"), F.col(f"b_{c}"))
    return wide.withColumns(made | {"nospace_ratio": scored("ratio", flat["a"], flat["b"])})


def group_features(pairs: DataFrame) -> DataFrame:
    """Adds the features of a pair's place within its s1_id: ranks that ties share, gaps to the best, size. One shuffle serves all."""
    group = Window.partitionBy("s1_id")

    def rank(c: str) -> Column:
        return F.rank().over(group.orderBy(F.col(c).desc())).cast("double")

    def gap(c: str) -> Column:
        return F.max(c).over(group) - F.col(c)

    return pairs.withColumns({
        "rank_name": rank("name_tset"), "rank_addr": rank("addr_tset"), "idf_rank": rank("key_idf"), "name_gap": gap("name_tset"), "addr_gap": gap("addr_tset"),
        "phon_gap": gap("phon_tset"), "idf_gap": gap("key_idf"), "n_cands": F.count("*").over(group).cast("double"),
    })


def pair_features(ranked: DataFrame) -> DataFrame:
    """s1_id, cand_id, cand_pos and FEATURES as float32, from ranked pairs with strings."""
    full = group_features(token_features(edit_features(ranked)))
    return full.select("s1_id", "cand_id", "cand_pos", *(F.col(f).cast("float").alias(f) for f in FEATURES))


def label(features: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds y: 1 if (s1_id, cand_id) is in gold. Joined by s1_id alone, by which features with ranks are dealt already."""
    true = gold.groupBy("s1_id").agg(F.collect_set("cand_id").alias("_true"))  # the matches of one entity
    return features.join(true, "s1_id", "left").withColumn("y", F.coalesce(F.array_contains("_true", F.col("cand_id")), F.lit(False)).cast("int")).drop("_true")
