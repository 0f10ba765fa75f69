"""Integrity of a pair of result files: header, arity, alignment, ids, duplicates, subset and one owner; and their statistics.

Files are read as lines with their places. Every check is an aggregate or a join; none holds ids in memory.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.sources.files import exists, numbered_lines

# The formats of ids and headers.
S1_ID, CAND_ID = r"^S1-\d+$", r"^(S2|S3)-\d+$"
HEADERS = {"candidates": "source1_entity_id\tcandidate_entity_ids", "matches": "source1_entity_id\tmatched_entity_ids"}
MOST_MESSAGES = 5


def _ids(text: Column) -> Column:
    """The ids of a list; a blank between commas is an id too, a wrong one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def aligned(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """The body lines of both files side by side, with what is wrong with them; the headers are line 0."""
    both = candidates.withColumnRenamed("line", "c").where("n > 0").join(matches.withColumnRenamed("line", "m").where("n > 0"), "n", "full")
    split = both.select("n", F.split("c", "\t").alias("c"), F.split("m", "\t").alias("m"))
    paired = F.col("c").isNotNull() & F.col("m").isNotNull()
    two = (F.size("c") == 2) & (F.size("m") == 2)
    good = paired & two & (F.get("c", F.lit(0)) == F.get("m", F.lit(0)))
    return split.select(
        "n", paired.alias("paired"), (paired & ~two).alias("bad_arity"), (paired & two & ~good).alias("misaligned"), good.alias("good"), F.get("c", F.lit(0)).alias("s1_id"),
        F.when(good, _ids(F.get("c", F.lit(1)))).alias("cands"), F.when(good, _ids(F.get("m", F.lit(1)))).alias("hits"),
    )


def violations(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """check and n (how often it is violated) of every check."""
    rows = aligned(candidates, matches)
    good = rows.where("good")

    def bad(ids: str) -> Column:
        return F.size(F.filter(ids, lambda x: ~x.rlike(CAND_ID)))

    simple = rows.agg(
        F.count_if("bad_arity").alias("arity"), F.count_if("misaligned").alias("alignment"), F.count_if(~F.col("paired")).alias("length"),
        F.count_if(F.col("good") & ~F.col("s1_id").rlike(S1_ID)).alias("s1_id"), F.coalesce(F.sum(bad("cands")), F.lit(0)).alias("candidate_id"),
        F.coalesce(F.sum(bad("hits")), F.lit(0)).alias("match_id"), F.coalesce(F.sum(F.size(F.filter("hits", lambda x: ~F.array_contains("cands", x)))), F.lit(0)).alias("subset"),
    )
    names = simple.columns
    flat = simple.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in names))).alias("x")).select("x.*")
    repeats = good.groupBy("s1_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n")).select(F.lit("duplicate_s1").alias("check"), "n")
    claims = good.select("n", "s1_id", F.explode("hits").alias("cand_id")).groupBy("cand_id", "s1_id").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    owners = claims.groupBy("cand_id").agg((F.sum("c") - F.min_by("c", F.struct("n", "s1_id"))).alias("others"))  # the first to claim it owns it
    shared = owners.agg(F.coalesce(F.sum("others"), F.lit(0)).cast("long").alias("n")).select(F.lit("one_owner").alias("check"), "n")
    heads = candidates.where("n = 0").select((F.col("line") != HEADERS["candidates"]).alias("x")).unionByName(matches.where("n = 0").select((F.col("line") != HEADERS["matches"]).alias("x")))
    header = heads.agg((F.lit(2) - F.count("x") + F.count_if("x")).cast("long").alias("n")).select(F.lit("header").alias("check"), "n")
    return header.unionByName(flat).unionByName(repeats).unionByName(shared)


def messages(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """The first lines with something wrong; a report of at most MOST_MESSAGES."""
    rows = aligned(candidates, matches).where(~F.coalesce("good", F.lit(False)))
    what = F.when(~F.col("paired"), "one file has no such line").when(F.col("bad_arity"), "not two fields").otherwise("different s1 ids")
    return rows.select("n", what.alias("message")).orderBy("n").limit(MOST_MESSAGES)


def statistics(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of totals: n_s1 counts the lines that both files have, the rest those that are aligned."""
    rows = aligned(candidates, matches)

    def of(ids: str, source: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(ids, lambda x: x.startswith(source)))), F.lit(0))

    def size(ids: str) -> Column:
        return F.coalesce(F.sum(F.size(ids)), F.lit(0))

    total = rows.agg(
        F.count_if("paired").alias("n_s1"), size("cands").alias("n_candidates"), size("hits").alias("n_matches"), F.count_if(F.size("cands") == 0).alias("no_candidates"),
        F.count_if(F.size("hits") == 0).alias("no_matches"), of("hits", "S2").alias("n_s2"), of("hits", "S3").alias("n_s3"), of("cands", "S2").alias("n_candidates_s2"), of("cands", "S3").alias("n_candidates_s3"),
    )
    unique = rows.where("good").select(F.explode("hits").alias("x")).agg(F.count_distinct("x").alias("n_unique"))
    return total.join(F.broadcast(unique))  # single rows


def histogram(candidates: DataFrame, matches: DataFrame, of: str = "cands", most: int = 10) -> DataFrame:
    """size (as text; the last for most and above) and n of the lists' sizes."""
    size = F.size(of)
    return aligned(candidates, matches).where("good").groupBy(F.when(size >= most, F.lit(f">={most}")).otherwise(size.cast("string")).alias("size")).agg(F.count("*").alias("n"))


def is_valid(candidates: DataFrame, matches: DataFrame) -> bool:
    return violations(candidates, matches).agg(F.sum("n")).first()[0] == 0


def validate_files(spark: SparkSession, candidates: str, matches: str, say=print) -> bool:
    """Whether two result files, or folders of parts, are there and without fault; says what was counted and found."""
    for path in (candidates, matches):
        if not exists(spark, path):
            say(f"{path}: not found")
            return False
    c, m = (numbered_lines(spark, p) for p in (candidates, matches))
    for name, n in statistics(c, m).first().asDict().items():
        say(f"{name}: {n:,}")
    for r in histogram(c, m, "hits").orderBy(F.length("size"), "size").collect():  # eleven rows at most
        say(f"{r.size} matches: {r.n:,}")
    found = {r.check: r.n for r in violations(c, m).collect()}
    for check, n in found.items():
        say(f"{check}: {n:,} violations")
    for r in messages(c, m).collect():
        say(f"line {r.n + 1}: {r.message}")
    return not any(found.values())


def main(argv: list[str]) -> int:
    """python -m kinlink.operators.validate CANDIDATES MATCHES: 0 if valid, else 1."""
    candidates, matches = argv if len(argv) == 2 else ("output/candidate_pairs.tsv", "output/matching_results.tsv")
    return 0 if validate_files(SparkSession.builder.appName("kinlink-validate").getOrCreate(), candidates, matches) else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
