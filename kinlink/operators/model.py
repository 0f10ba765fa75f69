"""Boosted trees over features, splits and folds by hash of the entity, and the two training stages."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.config import Config, stage2_grid
from kinlink.operators import decide
from kinlink.operators.similarity import FEATURES


def _digest(entity_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", entity_id, F.lit(seed)))


def bucket(entity_id: Column, n: int, seed: int = 42) -> Column:
    """A number below n that depends on the id alone, so that any later run, and any engine with MD5, finds the same split."""
    return (F.conv(F.substring(_digest(entity_id, seed), 1, 8), 16, 10).cast("long") % n).cast("int")


def sample_entities(s1: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n entities, the same in any run."""
    return s1.select(F.col("entity_id").alias("s1_id")).orderBy(_digest(F.col("s1_id"), seed), "s1_id").limit(n)


def _boosted(features: tuple[str, ...], **how) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error")
    trees = GBTClassifier(featuresCol="_x", labelCol="y", stepSize=0.05, maxBins=255, subsamplingRate=0.8, **how)
    return Pipeline(stages=[assembler, trees])


def fit_stage1(labelled: DataFrame, config: Config = Config(), trees: int | None = None) -> PipelineModel:
    return _boosted(FEATURES, maxIter=trees or config.max_trees, maxDepth=6, minInstancesPerNode=50, featureSubsetStrategy="0.8", seed=config.seed).fit(labelled)


def fit_stage2(labelled: DataFrame, config: Config = Config(), trees: int | None = None) -> PipelineModel:
    return _boosted(decide.CONTEXT, maxIter=trees or config.stage2_trees, maxDepth=5, minInstancesPerNode=200, featureSubsetStrategy="0.9", seed=config.seed).fit(labelled)


def score(model: PipelineModel, features: DataFrame, name: str = "prob") -> DataFrame:
    """Adds the probability of a match."""
    return model.transform(features).withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("_x", "prediction", "rawPrediction", "probability")


def train_stage1(labelled: DataFrame, entities: DataFrame, gold: DataFrame, config: Config = Config(), trees: int | None = None) -> tuple[PipelineModel, float, float, float]:
    """The model on four fifths of the entities, and the thresholds with the best macro F0.5 on the rest."""
    held = bucket(F.col("s1_id"), 5, config.seed) == 0
    model = fit_stage1(labelled.where(~held), config, trees)
    return model, *decide.best_setting(held_out_grid(score(model, labelled.where(held), "p"), entities, gold, config))


def held_out_grid(scored: DataFrame, entities: DataFrame, gold: DataFrame, config: Config = Config()) -> DataFrame:
    """The threshold grid on the fifth of the entities that the first stage does not learn from."""
    held = bucket(F.col("s1_id"), 5, config.seed) == 0
    inside = entities.where(held)
    return decide.threshold_grid(scored.where(held), inside, gold.join(inside.select("s1_id"), "s1_id", "left_semi"))


Scorer = Callable[[DataFrame], DataFrame]


def second(model: PipelineModel) -> Scorer:
    """A model of the second stage as a function that adds p2."""
    return partial(score, model, name="p2")


def cross_validate(context: DataFrame, entities: DataFrame, gold: DataFrame, config: Config = Config(), trees: int | None = None, learn: Callable[[DataFrame], Scorer] | None = None) -> tuple[float, float]:
    """The best single threshold and its macro F0.5 on the pooled scores of models that have not seen an entity's fold. learn: from labelled rows to a Scorer; boosted trees if not given."""
    fold = bucket(F.col("s1_id"), config.folds, config.seed + 1)
    learn = learn or (lambda rows: second(fit_stage2(rows, config, trees)))

    def one(k: int) -> DataFrame:
        return learn(context.where(fold != k))(context.where(fold == k)).select("s1_id", "cand_id", "cand_pos", "p2")

    with ThreadPoolExecutor(config.threads) as pool:
        parts = list(pool.map(one, range(config.folds)))
    pooled = parts[0]
    for part in parts[1:]:
        pooled = pooled.unionByName(part)
    top, _, best = decide.best_setting(decide.threshold_grid(pooled, entities, gold, [(t, t) for t in stage2_grid()], p="p2"))
    return top, best


def choose_tau(context: DataFrame, entities: DataFrame, gold: DataFrame, config: Config = Config(), trees: int | None = None, learn: Callable[[DataFrame], Scorer] | None = None) -> list[dict]:
    """tau, threshold and f05 for every tau, and which is chosen: the largest within tolerance of the best."""
    rows = []
    for tau in config.taus:
        top, best = cross_validate(context.where(F.col("p") >= tau), entities, gold, config, trees, learn)
        rows.append({"tau": tau, "threshold": top, "f05": best})
    enough = max(r["f05"] for r in rows) - config.tolerance
    chosen = max(r["tau"] for r in rows if r["f05"] >= enough)
    return [r | {"chosen": r["tau"] == chosen} for r in rows]


def apply_stage2(scorer: Scorer, scored: DataFrame, tau: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Candidates from tau on, and the matches: context over the full lists, then the cut, the second score, one owner, decoding."""
    pruned = decide.context_features(scored).where(F.col("p") >= tau)
    claims = scorer(pruned).where(F.col("p2") >= threshold)
    return pruned, decide.decode(decide.one_owner(claims, "p2"), threshold, p="p2")
