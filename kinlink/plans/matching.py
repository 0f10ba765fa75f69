"""The stages of matching put together, each a table on disk that a later run takes up where it is done."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.config import Config
from kinlink.operators import blocking, decide, model, similarity
from kinlink.sources import files

log = logging.getLogger("kinlink")


@dataclass
class Work:
    """Where inputs and stages are. prep_root and index_root may be another run's."""

    data: str
    root: str
    prep_root: str | None = None
    index_root: str | None = None
    config: Config = Config()

    def prep(self, split: str, source: int) -> str:
        return f"{self.prep_root or self.root}/prep/{split}/s{source}"

    def index(self, split: str) -> str:
        return f"{self.index_root or self.root}/index/{split}"


def features_of(s1: DataFrame, others: DataFrame, index: DataFrame, config: Config = Config()) -> DataFrame:
    """From prepared records to pairs with all features, as one plan."""
    pairs = blocking.candidate_pairs(blocking.blocking_keys(s1), index, config)
    return similarity.pair_features(blocking.rank_candidates(pairs, s1, others, config))


SLICES, SLICE_ENTITIES = 16, 12_000


def sliced_features(s1: DataFrame, others: DataFrame, index: DataFrame, config: Config = Config(), gold: DataFrame | None = None, entities: int = SLICE_ENTITIES) -> DataFrame:
    """features_of all of s1, labelled where gold is given, as a written table. s1, others and index are tables, as they are read often.

    The pairs before the second cut, with their strings, take many times the room of the records; so s1 is dealt into
    slices by hash, of some so many entities until there are SLICES, and the shuffles of one are gone before the next."""
    n = min(SLICES, 1 + s1.count() // entities)

    def part(df: DataFrame, id_: str, k: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64(id_), F.lit(n)) == k) if n > 1 else df

    def made(k: int) -> DataFrame:
        found = features_of(part(s1, "entity_id", k), others, index, config)
        return found if gold is None else similarity.label(found, part(gold, "s1_id", k))

    return files.written_parts(map(made, range(n)))


def prep(spark: SparkSession, work: Work, split: str) -> list[DataFrame]:
    def made(n: int) -> DataFrame:
        return files.stage(spark, work.prep(split, n), lambda: blocking.prepare(files.read_records(spark, f"{work.data}/{split}/{split}_source{n}.tsv")))

    return [made(n) for n in (1, 2, 3)]


def index(spark: SparkSession, work: Work, split: str) -> DataFrame:
    _, s2, s3 = prep(spark, work, split)
    return files.stage(spark, work.index(split), lambda: blocking.build_index(blocking.blocking_keys(s2.unionByName(s3)), work.config))


def trainfe(spark: SparkSession, work: Work) -> DataFrame:
    s1, s2, s3 = prep(spark, work, "train")
    gold = files.read_gold(spark, f"{work.data}/train/train_ground_truth.tsv")

    def make() -> DataFrame:
        chosen = model.sample_entities(s1, work.config.train_sample, work.config.seed)
        mine = s1.join(chosen.withColumnRenamed("s1_id", "entity_id"), "entity_id", "left_semi")
        return similarity.label(features_of(mine, s2.unionByName(s3), index(spark, work, "train"), work.config), gold)

    return files.stage(spark, f"{work.root}/features/train", make)


def train(spark: SparkSession, work: Work, trees: int | None = None) -> dict:
    done = f"{work.root}/model/threshold"
    if not files.is_done(spark, done):
        s1 = prep(spark, work, "train")[0]
        gold = files.read_gold(spark, f"{work.data}/train/train_ground_truth.tsv")
        chosen = model.sample_entities(s1, work.config.train_sample, work.config.seed)
        fitted, top, rest, best = model.train_stage1(trainfe(spark, work), chosen, gold, work.config, trees)
        files.write_model(fitted, f"{work.root}/model/stage1")
        files.write_settings(spark, done, [{"t_top": top, "t_rest": rest, "val_f05": best}])
    return files.read_settings(spark, done)[0]


def testfe(spark: SparkSession, work: Work) -> DataFrame:
    s1, s2, s3 = prep(spark, work, "test")

    def make() -> DataFrame:
        pairs = features_of(s1, s2.unionByName(s3), index(spark, work, "test"), work.config)
        return model.score(files.read_model(f"{work.root}/model/stage1"), pairs, "prob").select("s1_id", "cand_id", "cand_pos", "prob")

    return files.stage(spark, f"{work.root}/scored/test", make)


def write(spark: SparkSession, work: Work, out: str) -> None:
    """All candidates, and the matches: an owner is chosen before decoding, so a claim that decoding refuses still keeps weaker ones out."""
    setting, scored = train(spark, work), testfe(spark, work)
    entities = prep(spark, work, "test")[0].select(F.col("entity_id").alias("s1_id"))
    claims = scored.where(F.col("prob") >= min(setting["t_top"], setting["t_rest"]))
    matched = decide.decode(decide.one_owner(claims, "prob"), setting["t_top"], setting["t_rest"], "prob")
    files.write_lists(decide.match_lists(entities, matched), f"{out}/matching_results")
    files.write_lists(decide.match_lists(entities, scored, "candidate_entity_ids"), f"{out}/candidate_pairs")


def stage2(spark: SparkSession, work: Work, out: str, trees: int | None = None) -> list[dict]:
    """The second model on the held-out entities, tau by cross-validation, pruned candidates and final matches."""
    config = work.config
    held = model.bucket(F.col("s1_id"), 5, config.seed) == 0
    gold = files.read_gold(spark, f"{work.data}/train/train_ground_truth.tsv")
    entities = model.sample_entities(prep(spark, work, "train")[0], config.train_sample, config.seed).where(held)
    of_entities = gold.join(entities, "s1_id", "left_semi")
    first = files.read_model(f"{work.root}/model/stage1")
    context = files.stage(spark, f"{work.root}/features/context", lambda: decide.context_features(model.score(first, trainfe(spark, work).where(held), "p").select("s1_id", "cand_id", "cand_pos", "p", "y")))
    table = model.choose_tau(context, entities, of_entities, config, trees)
    chosen = next(r for r in table if r["chosen"])
    fitted = model.fit_stage2(context.where(F.col("p") >= chosen["tau"]), config, trees)
    files.write_model(fitted, f"{work.root}/model/stage2")
    pruned, matched = model.apply_stage2(model.second(fitted), testfe(spark, work).withColumnRenamed("prob", "p"), chosen["tau"], chosen["threshold"])
    everyone = prep(spark, work, "test")[0].select(F.col("entity_id").alias("s1_id"))
    files.write_lists(decide.match_lists(everyone, pruned, "candidate_entity_ids"), f"{out}/candidate_pairs")
    files.write_lists(decide.match_lists(everyone, matched), f"{out}/matching_results")
    files.write_settings(spark, f"{out}/stats", table)
    return table


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--stage", default="all", choices=["all", "prep", "index", "trainfe", "train", "testfe", "write", "stage2"])
    for name in ("--data", "--work", "--out"):
        parser.add_argument(name, required=True)
    for name in ("--prep-root", "--index-root"):
        parser.add_argument(name)
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s", datefmt="%H:%M:%S")
    spark, work = SparkSession.builder.appName("kinlink").getOrCreate(), Work(a.data, a.work, a.prep_root, a.index_root)
    steps = {
        "prep": lambda: [prep(spark, work, s) for s in ("train", "test")], "index": lambda: [index(spark, work, s) for s in ("train", "test")], "trainfe": lambda: trainfe(spark, work),
        "train": lambda: train(spark, work), "testfe": lambda: testfe(spark, work), "write": lambda: write(spark, work, a.out), "stage2": lambda: stage2(spark, work, a.out),
    }
    for name, step in steps.items():
        if a.stage == name or a.stage == "all" and name != "stage2":
            log.info("stage %s", name)
            step()


if __name__ == "__main__":
    main()
