"""Every operator of matching as a query over the derived records, with its SQL where SQL can express it.

Where decisions need a probability and no model is asked for, a pair's is key_idf / (key_idf + 10).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.config import Config, pair_grid, single_grid, stage2_grid
from kinlink.functions import text
from kinlink.operators import blocking, decide, evaluate, model, similarity, validate
from kinlink.plans import matching
from kinlink.plans.features import PAIRS_SQL, RANKED_SQL, RUNS, TOKENS, wide
from kinlink.plans.sql import KEYS, RECORDS_SPARK, query
from kinlink.sources import files

CONFIG = Config()
T_TOP, T_REST = 0.5, 0.7
SAMPLE, STAGE2_FROM = 200, 0.3


class Derived:
    """The tables of matching, from the documents of a folder; each is a plan, and nothing is run but by keep() and features()."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._pre: DataFrame | None = None
        self.docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
        self.records = spark.sql(RECORDS_SPARK, documents=self.docs)
        self.prepared = blocking.prepare(self.records)
        self.entities = self.docs.select(F.concat(F.lit("S1-"), "doc_id").alias("s1_id"))

    @staticmethod
    def of(records: DataFrame, first: bool) -> DataFrame:
        return records.where(F.col("entity_id").startswith("S1") if first else ~F.col("entity_id").startswith("S1"))

    @property
    def gold(self) -> DataFrame:
        def pairs(source: str, where: str) -> DataFrame:
            return self.docs.where(where).select(F.concat(F.lit("S1-"), "doc_id").alias("s1_id"), F.concat(F.lit(source), "doc_id").alias("cand_id"))

        return pairs("S2-", "doc_id % 3 <> 0").unionByName(pairs("S3-", "doc_id % 4 = 0"))

    def keys(self, first: bool) -> DataFrame:
        return blocking.blocking_keys(self.of(self.prepared, first))

    @property
    def index(self) -> DataFrame:
        return blocking.build_index(self.keys(False), CONFIG)

    def keep(self) -> Derived:
        """Writes the candidate pairs, for plans that read them in several branches."""
        self._pre = files.written(self.pre)
        return self

    @property
    def pre(self) -> DataFrame:
        return self._pre or blocking.candidate_pairs(self.keys(True), self.index, CONFIG)

    @property
    def scored(self) -> DataFrame:
        idf = F.col("key_idf").cast("double")
        return self.pre.where(F.col("cand_pos") <= CONFIG.top_k).select("s1_id", "cand_id", "cand_pos", (idf / (idf + 10)).alias("p"))

    @property
    def owned(self) -> DataFrame:
        return decide.one_owner(self.scored)

    @property
    def matched(self) -> DataFrame:
        return decide.decode(self.owned, T_TOP, T_REST)

    @property
    def ranked(self) -> DataFrame:
        return blocking.rank_candidates(self.pre, self.of(self.prepared, True), self.of(self.prepared, False), CONFIG)

    def features(self, gold: DataFrame | None = None) -> DataFrame:
        """All features of the ranked pairs, labelled where gold is given, written slice by slice."""
        self.prepared = files.written(self.prepared)
        index = blocking.build_index(files.written(self.keys(False)), CONFIG)  # which reads the keys twice
        return matching.sliced_features(self.of(self.prepared, True), self.of(self.prepared, False), files.written(index), CONFIG, gold)


def _lines(d: Derived, pairs: DataFrame, column: str) -> DataFrame:
    lists = decide.match_lists(d.entities, pairs, column)
    number = F.substring_index("source1_entity_id", "-", -1).cast("long") + 1
    body = lists.select(number.alias("n"), F.concat_ws("\t", "source1_entity_id", column).alias("line"))
    head = d.docs.sparkSession.createDataFrame([(0, f"source1_entity_id\t{column}")], "n long, line string")
    return head.unionByName(body)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def _validated(d: Derived) -> DataFrame:
    """Violations of the result files with faults of every kind put into some lines, by the entity's number."""
    d.keep()
    kind = (F.col("n") - 1) % 100
    c, m = _lines(d, d.scored, "candidate_entity_ids"), _lines(d, d.matched, "matched_entity_ids")
    body = F.col("n") > 0

    def put(lines: DataFrame, faults: dict[int, Column]) -> DataFrame:
        line = F
        for k, wrong in faults.items():
            line = line.when(body & (kind == k), wrong)
        return lines.withColumn("line", line.otherwise(F.col("line")))

    line = F.col("line")
    both = {17: F.concat(F.lit("X"), line), 41: F.regexp_replace(line, "^S1-[0-9]+", "S1-1")}
    c = put(c, both | {7: F.concat(line, F.lit("\tx")), 23: F.concat(line, F.lit(",,S9-1"))}).where(~body | (kind != 37))
    m = put(m, both | {13: F.concat(F.lit("S1-0"), line), 29: F.concat(line, F.lit(",")), 31: F.concat(line, F.lit(",S2-1"))})
    return validate.violations(c, m.withColumn("line", F.when(body, line).otherwise("wrong")))


def _totals(d: Derived) -> DataFrame:
    d.keep()
    return validate.statistics(_lines(d, d.scored, "candidate_entity_ids"), _lines(d, d.matched, "matched_entity_ids"))


def _sizes(d: Derived) -> DataFrame:
    d.keep()
    return validate.histogram(_lines(d, d.scored, "candidate_entity_ids"), _lines(d, d.matched, "matched_entity_ids"), "hits")


def _numbers(d: Derived) -> DataFrame:
    a = text.words(F.col("addr_n"))
    return d.prepared.select("entity_id", F.array_join(F.array_sort(text.digit_runs(F.col("addr_n"))), " ").alias("runs"), F.array_join(text.number_tokens(a), " ").alias("numbers"))


def _tokens(d: Derived) -> DataFrame:
    wide = blocking.with_strings(d.pre, d.of(d.prepared, True), d.of(d.prepared, False))
    return _rounded(similarity.token_features(wide).select("s1_id", "cand_id", *TOKENS))


def _gbm(d: Derived) -> DataFrame:
    """The first stage: all its trees, trained on four fifths of the entities, scoring all pairs."""
    labelled = d.features(d.gold)
    held = model.bucket(F.col("s1_id"), 5) == 0
    return model.score(model.fit_stage1(labelled.where(~held), CONFIG), labelled, "prob").select("s1_id", "cand_id", "cand_pos", "y", "prob")


def _labelled(d: Derived) -> DataFrame:
    """Pairs with their context and label."""
    return similarity.label(decide.context_features(d.keep().scored), d.gold)


CELL = ("_rank", "is_s3", "s3_best")


def _rates(rows: DataFrame) -> model.Scorer:
    """Stands in for trees where SQL is to follow: the rate of matches among the labelled rows of a cell, of which there are at most 20."""

    def cells(df: DataFrame) -> DataFrame:
        return df.withColumn("_rank", F.least("p_rank", F.lit(5.0)))

    rates = cells(rows).groupBy(*CELL).agg(((F.sum("y") + 1) / (F.count("*") + 2)).alias("rate"))
    return lambda df: cells(df).join(F.broadcast(rates), list(CELL), "left").withColumn("p2", F.coalesce("rate", F.lit(0.5))).drop("_rank", "rate")


def _taus(d: Derived) -> DataFrame:
    """Threshold and cross-validated F0.5 of every pruning level, and which is chosen."""
    table = model.choose_tau(files.written(_labelled(d)), d.entities, d.gold, CONFIG, learn=_rates)
    return d.docs.sparkSession.createDataFrame([(r["tau"], r["threshold"], r["f05"], r["chosen"]) for r in table], "tau double, threshold double, f05 double, chosen boolean")


def _stage2(d: Derived) -> tuple[DataFrame, DataFrame]:
    """Pruned candidates and matches of the second stage at the published pruning level."""
    labelled = files.written(_labelled(d))
    return model.apply_stage2(_rates(labelled.where(F.col("p") >= CONFIG.tau)), d.scored, CONFIG.tau, STAGE2_FROM)


def _split(d: Derived) -> DataFrame:
    id_ = F.col("s1_id")
    return d.entities.select("s1_id", (model.bucket(id_, 5, CONFIG.seed) == 0).alias("held"), model.bucket(id_, CONFIG.folds, CONFIG.seed + 1).alias("fold"))


def _read_back(d: Derived) -> DataFrame:
    path = f"{files.scratch(d.docs.sparkSession)}/records"
    files.write_records(d.records, path)
    return files.read_records(d.docs.sparkSession, path)


def _gold_back(d: Derived) -> DataFrame:
    path = f"{files.scratch(d.docs.sparkSession)}/gold"
    files.write_lists(decide.match_lists(d.entities, d.gold), path)
    return files.read_gold(d.docs.sparkSession, path)


def _index_back(d: Derived) -> DataFrame:
    """The index of a stage that is made once; the second call finds it done and reads three of its columns."""
    spark, path = d.docs.sparkSession, f"{files.scratch(d.docs.sparkSession)}/index"
    files.stage(spark, path, lambda: d.index)
    return _rounded(files.stage(spark, path, lambda: d.index.limit(0), ["cand_id", "key", "w"]), 5)


def _family(name: str) -> Callable[[Derived], DataFrame]:
    return lambda d: blocking.blocking_keys(d.prepared, (name,))


PLANS: dict[str, Callable[[Derived], DataFrame]] = {
    "entity_records": lambda d: d.records,
    "prepared_records": lambda d: d.prepared,
    "number_tokens": _numbers,
    **{f"keys_{f}": _family(f) for f in KEYS},
    "blocking_keys": lambda d: blocking.blocking_keys(d.prepared),
    "block_sizes": lambda d: blocking.block_sizes(d.keys(False)),
    "key_index": lambda d: _rounded(d.index, 5),
    "pair_counts": lambda d: _rounded(blocking.pair_counts(d.keys(True), d.index), 4),
    "candidate_pairs": lambda d: _rounded(d.pre, 4),
    "token_features": _tokens,
    "ranked_candidates": lambda d: d.ranked.select("s1_id", "cand_id", "cand_pos", "shared_keys", "key_idf", "name_tset", "addr_tset"),
    "pair_features": lambda d: d.features(),
    "context_features": lambda d: _rounded(decide.context_features(d.scored)),
    "one_owner": lambda d: _rounded(d.owned),
    "decoded_matches": lambda d: _rounded(d.matched),
    "match_lists": lambda d: decide.match_lists(d.entities, d.matched),
    "candidate_lists": lambda d: decide.match_lists(d.entities, d.scored, "candidate_entity_ids"),
    "macro_f05": lambda d: _rounded(decide.macro_f05(d.entities, d.matched, d.gold)),
    "entity_f05": lambda d: _rounded(decide.entity_f05(d.entities, d.matched, d.gold)),
    "threshold_grid": lambda d: _rounded(decide.threshold_grid(d.scored, d.entities, d.gold)),
    "all_empty_floor": lambda d: _rounded(evaluate.all_empty_floor(d.entities, d.gold)),
    "f05_ceiling": lambda d: _rounded(evaluate.f05_ceiling(d.keep().scored, d.entities, d.gold)),
    "blocking_recall": lambda d: _rounded(evaluate.blocking_recall(d.keep().scored, d.entities, d.gold)),
    "miss_classes": lambda d: evaluate.miss_classes(d.gold, d.keys(True), d.keys(False), d.scored, CONFIG),
    "pruning_curve": lambda d: _rounded(evaluate.pruning_curve(d.keep().scored, d.entities, d.gold, CONFIG)),
    "country_counts": lambda d: evaluate.country_counts(d.prepared),
    "claim_counts": lambda d: evaluate.claim_counts(d.keep().scored, d.owned, d.entities),
    "validated_lists": _validated,
    "list_statistics": _totals,
    "list_histogram": _sizes,
    "gbm_scores": _gbm,
    "labelled_pairs": lambda d: _rounded(similarity.label(d.scored, d.gold)),
    "entity_sample": lambda d: model.sample_entities(d.of(d.prepared, True), SAMPLE, CONFIG.seed),
    "entity_split": _split,
    "held_out_grid": lambda d: _rounded(model.held_out_grid(d.scored, d.entities, d.gold, CONFIG)),
    "tau_choice": lambda d: _rounded(_taus(d)),
    "pruned_candidates": lambda d: _rounded(_stage2(d)[0].select("s1_id", "cand_id", "cand_pos", "p", "p_rank")),
    "stage2_matches": lambda d: _rounded(_stage2(d)[1].select("s1_id", "cand_id", "cand_pos", "p2")),
    "records_file": _read_back,
    "gold_file": _gold_back,
    "index_stage": _index_back,
}

_SETTINGS = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate([(t, t) for t in single_grid()] + pair_grid()))
_F05 = "CASE WHEN n_gold = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN hits = 0 THEN 0.0 ELSE 1.25 * (hits / n_pred) * (hits / n_gold) / (0.25 * (hits / n_pred) + hits / n_gold) END"


def _f05_sql(pairs: str) -> str:
    return f"""SELECT e.s1_id, coalesce(np, 0)::BIGINT AS n_pred, coalesce(ng, 0)::BIGINT AS n_gold, coalesce(h, 0)::BIGINT AS hits FROM entities e
  LEFT JOIN (SELECT s1_id, count(*) AS np FROM {pairs} GROUP BY 1) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS ng FROM gold GROUP BY 1) USING (s1_id)
  LEFT JOIN (SELECT s1_id, count(*) AS h FROM {pairs} JOIN gold USING (s1_id, cand_id) GROUP BY 1) USING (s1_id)"""


def _macro(pairs: str) -> str:
    return f"SELECT round(avg(f), 6) AS f05, count(*) AS n_entities FROM (SELECT {_F05} AS f FROM ({_f05_sql(pairs)}))"


_LISTS = "coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '')"

_CONTEXT = """, c AS (SELECT *, (left(cand_id, 2) = 'S3')::INT::DOUBLE AS is_s3, row_number() OVER o::DOUBLE AS p_rank, max(p) OVER g AS p_top1,
  coalesce(nth_value(p, 2) OVER (PARTITION BY s1_id ORDER BY p DESC, cand_pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS p_top2, p - lead(p, 1, 0.0) OVER o AS p_gap2,
  (count(*) FILTER (p >= 0.5) OVER g)::DOUBLE AS n_ge05, (count(*) FILTER (p >= 0.3) OVER g)::DOUBLE AS n_ge03, sum(p) OVER g AS p_sum, (count(*) OVER g)::DOUBLE AS n_cands,
  (p >= max(p) OVER (PARTITION BY s1_id, left(cand_id, 2)))::INT::DOUBLE AS b FROM scored WINDOW g AS (PARTITION BY s1_id), o AS (PARTITION BY s1_id ORDER BY p DESC, cand_pos))
"""


def _grid(entities: str) -> str:
    return f""", grid(pos, t_top, t_rest) AS (VALUES {_SETTINGS}), r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_pos) AS n FROM scored WHERE s1_id IN (SELECT s1_id FROM {entities})),
k AS (SELECT pos, r.s1_id, count(*) AS n_pred, count(g.s1_id) AS hits FROM r JOIN grid ON (n = 1 AND p >= t_top) OR p >= t_rest LEFT JOIN gold g ON g.s1_id = r.s1_id AND g.cand_id = r.cand_id GROUP BY ALL),
e AS (SELECT s1_id, count(g.s1_id) AS n_gold FROM {entities} LEFT JOIN gold g USING (s1_id) GROUP BY 1)
SELECT pos, t_top, t_rest, round(avg({_F05}), 6) AS f05 FROM (SELECT grid.*, n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(hits, 0) AS hits FROM grid CROSS JOIN e LEFT JOIN k ON k.pos = grid.pos AND k.s1_id = e.s1_id) GROUP BY ALL"""


def _part(n: int, seed: int) -> str:
    return f"('0x' || substr(md5(s1_id || ':{seed}'), 1, 8))::BIGINT % {n}"


_HELD = f"(SELECT s1_id FROM entities WHERE {_part(5, CONFIG.seed)} = 0)"
_CTX = f"""{_CONTEXT}, ctx AS MATERIALIZED (SELECT c.s1_id, c.cand_id, cand_pos, p, p_rank, least(p_rank, 5.0) AS r, is_s3, b * is_s3 AS s3_best, (g.s1_id IS NOT NULL)::INT AS y,
  {_part(CONFIG.folds, CONFIG.seed + 1).replace('s1_id', 'c.s1_id')} AS fold FROM c LEFT JOIN gold g ON g.s1_id = c.s1_id AND g.cand_id = c.cand_id)
"""
_TAUS = f"""{_CTX}, taus AS (SELECT unnest({list(CONFIG.taus)})::DOUBLE AS tau), steps AS (SELECT unnest({stage2_grid()})::DOUBLE AS t), folds AS (SELECT unnest(range({CONFIG.folds})) AS k),
cells AS (SELECT tau, k, r, is_s3, s3_best, (sum(y) + 1) / (count(*) + 2) AS rate FROM taus JOIN ctx ON p >= tau JOIN folds ON fold <> k GROUP BY ALL),
pooled AS MATERIALIZED (SELECT u.tau, x.s1_id, x.y, coalesce(rate, 0.5) AS p2 FROM taus u JOIN ctx x ON x.p >= u.tau LEFT JOIN cells z ON z.tau = u.tau AND z.k = x.fold AND z.r = x.r AND z.is_s3 = x.is_s3 AND z.s3_best = x.s3_best),
n AS (SELECT tau, t, s1_id, count(*) AS n_pred, sum(y) AS hits FROM pooled JOIN steps ON p2 >= t GROUP BY ALL), e AS (SELECT s1_id, count(g.s1_id) AS n_gold FROM entities LEFT JOIN gold g USING (s1_id) GROUP BY 1),
f AS (SELECT tau, t, avg({_F05}) AS f05 FROM (SELECT tau, t, n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(hits, 0) AS hits FROM taus CROSS JOIN steps CROSS JOIN e LEFT JOIN n USING (tau, t, s1_id)) GROUP BY ALL),
best AS (SELECT tau, t AS threshold, f05, max(f05) OVER () - {CONFIG.tolerance} <= f05 AS enough FROM f QUALIFY row_number() OVER (PARTITION BY tau ORDER BY round(f05, 10) DESC, t) = 1)
SELECT tau, threshold, round(f05, 6) AS f05, tau = (SELECT max(tau) FROM best WHERE enough) AS chosen FROM best"""
_APPLIED = f"""{_CTX}, rates AS (SELECT r, is_s3, s3_best, (sum(y) + 1) / (count(*) + 2) AS rate FROM ctx WHERE p >= {CONFIG.tau} GROUP BY ALL),
claims AS (SELECT s1_id, cand_id, cand_pos, rate AS p2 FROM ctx JOIN rates USING (r, is_s3, s3_best) WHERE p >= {CONFIG.tau} AND rate >= {STAGE2_FROM}),
kept AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY p2 DESC, split_part(s1_id, '-', 2)::BIGINT) = 1)
SELECT s1_id, cand_id, cand_pos, round(p2, 6) AS p2 FROM kept"""

SELECTS: dict[str, str] = {
    "entity_records": "SELECT * FROM records",
    "prepared_records": "SELECT entity_id, name_n, core, addr_n, country_n, phon FROM prepared",
    "number_tokens": f"""SELECT entity_id, array_to_string({RUNS.format('addr_n').replace('list_distinct(', 'list_sort(list_distinct(').replace('END))', 'END)))')}, ' ') AS runs, array_to_string(num, ' ') AS numbers
  FROM ready JOIN prepared USING (entity_id)""",
    **{f"keys_{f}": f"SELECT DISTINCT entity_id, country_n || '|' || unnest({KEYS[f]}) AS key FROM ready" for f in KEYS},
    "blocking_keys": "SELECT entity_id, key FROM keys",
    "block_sizes": "SELECT key, block_size FROM sizes",
    "key_index": "SELECT cand_id, key, block_size, round(w, 5) AS w FROM idx",
    "pair_counts": "SELECT s1_id, cand_id, shared_keys, round(key_idf, 4) AS key_idf FROM met",
    "candidate_pairs": "SELECT s1_id, cand_id, shared_keys, round(key_idf, 4) AS key_idf, cand_pos FROM pre",
    "token_features": f", {wide('pre')} SELECT s1_id, cand_id, {', '.join(f'round({c}, 6) AS {n}' for n, c in TOKENS.items())} FROM wide",
    "ranked_candidates": RANKED_SQL,
    "pair_features": PAIRS_SQL,
    "context_features": _CONTEXT + """SELECT s1_id, cand_id, cand_pos, round(p, 6) AS p, is_s3, p_rank, round(p_top1, 6) AS p_top1, round(p_top2, 6) AS p_top2, round(p_gap2, 6) AS p_gap2, n_ge05, n_ge03, round(p_sum, 6) AS p_sum, n_cands,
  round(p_top1 - p, 6) AS p_gap, round(p / greatest(p_sum, 1e-9), 6) AS p_share, b * is_s3 AS s3_best, b * (1 - is_s3) AS s2_best FROM c""",
    "one_owner": "SELECT s1_id, cand_id, cand_pos, round(p, 6) AS p FROM owned",
    "decoded_matches": "SELECT s1_id, cand_id, cand_pos, round(p, 6) AS p FROM decoded",
    "match_lists": f"SELECT s1_id AS source1_entity_id, {_LISTS} AS matched_entity_ids FROM entities LEFT JOIN decoded USING (s1_id) GROUP BY 1",
    "candidate_lists": f"SELECT s1_id AS source1_entity_id, {_LISTS} AS candidate_entity_ids FROM entities LEFT JOIN scored USING (s1_id) GROUP BY 1",
    "macro_f05": _macro("decoded"),
    "entity_f05": f"SELECT s1_id, n_pred, n_gold, hits, round({_F05}, 6) AS f05 FROM ({_f05_sql('decoded')})",
    "threshold_grid": _grid("entities"),
    "all_empty_floor": _macro("(SELECT * FROM gold LIMIT 0)"),
    "f05_ceiling": _macro("(SELECT s1_id, cand_id FROM scored JOIN gold USING (s1_id, cand_id))"),
    "blocking_recall": """SELECT *, round(n_found / greatest(n_gold, 1), 6) AS recall, round(n_pairs / greatest(n_entities, 1), 6) AS pairs_each FROM (SELECT (SELECT count(*) FROM gold) AS n_gold,
  (SELECT count(*) FROM gold JOIN scored USING (s1_id, cand_id)) AS n_found, (SELECT count(*) FROM scored) AS n_pairs, (SELECT count(*) FROM entities) AS n_entities)""",
    "miss_classes": """, l AS (SELECT g.s1_id, g.cand_id, min(block_size) AS least FROM gold g JOIN mine m ON m.s1_id = g.s1_id JOIN theirs t ON t.cand_id = g.cand_id AND t.key = m.key JOIN sizes z ON z.key = m.key GROUP BY ALL)
SELECT CASE WHEN s.s1_id IS NOT NULL THEN 'found' WHEN least IS NULL THEN 'no shared key' WHEN least > 200 THEN 'key too frequent' ELSE 'cut by ranking' END AS status, count(*) AS n
FROM gold g LEFT JOIN scored s ON s.s1_id = g.s1_id AND s.cand_id = g.cand_id LEFT JOIN l ON l.s1_id = g.s1_id AND l.cand_id = g.cand_id GROUP BY 1""",
    "pruning_curve": """SELECT tau::DOUBLE AS tau, round(count(*) / (SELECT count(*) FROM entities), 6) AS pairs_each, round(count(g.s1_id) / (SELECT count(*) FROM gold), 6) AS recall
FROM scored s JOIN (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.15, 0.2]) AS tau) ON p >= tau LEFT JOIN gold g ON g.s1_id = s.s1_id AND g.cand_id = s.cand_id GROUP BY 1""",
    "country_counts": "SELECT country_n, count(*) AS n FROM prepared GROUP BY 1",
    "claim_counts": "SELECT (SELECT count(*) FROM scored) - (SELECT count(*) FROM owned) AS n_removed, (SELECT count(*) FROM entities WHERE s1_id NOT IN (SELECT s1_id FROM owned)) AS n_empty",
    "validated_lists": """, files AS (SELECT split_part(s1_id, '-', 2)::BIGINT AS i, s1_id, coalesce(c, '') AS c, coalesce(m, '') AS m FROM entities
  LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS c FROM scored GROUP BY 1) USING (s1_id) LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS m FROM decoded GROUP BY 1) USING (s1_id)),
wrong AS (SELECT i, CASE i % 100 WHEN 17 THEN 'X' || s1_id WHEN 41 THEN 'S1-1' ELSE s1_id END || chr(9) || c || CASE i % 100 WHEN 7 THEN chr(9) || 'x' WHEN 23 THEN ',,S9-1' ELSE '' END AS c,
  CASE i % 100 WHEN 17 THEN 'X' || s1_id WHEN 41 THEN 'S1-1' WHEN 13 THEN 'S1-0' || s1_id ELSE s1_id END || chr(9) || m || CASE i % 100 WHEN 29 THEN ',' WHEN 31 THEN ',S2-1' ELSE '' END AS m FROM files),
parsed AS (SELECT i, i % 100 = 37 AS gone, string_split(c, chr(9)) AS c, string_split(m, chr(9)) AS m FROM wrong),
good AS (SELECT i, c[1] AS s, CASE WHEN c[2] = '' THEN []::VARCHAR[] ELSE string_split(c[2], ',') END AS cs, CASE WHEN m[2] = '' THEN []::VARCHAR[] ELSE string_split(m[2], ',') END AS ms
  FROM parsed WHERE NOT gone AND len(c) = 2 AND len(m) = 2 AND c[1] = m[1]),
claims AS (SELECT i, s, unnest(ms) AS x FROM good)
SELECT 'header' AS "check", 1::BIGINT AS n UNION ALL SELECT 'arity', count(*) FROM parsed WHERE NOT gone AND (len(c) <> 2 OR len(m) <> 2)
UNION ALL SELECT 'alignment', count(*) FROM parsed WHERE NOT gone AND len(c) = 2 AND len(m) = 2 AND c[1] <> m[1] UNION ALL SELECT 'length', count(*) FROM parsed WHERE gone
UNION ALL SELECT 's1_id', count(*) FROM good WHERE NOT regexp_full_match(s, 'S1-[0-9]+')
UNION ALL SELECT 'candidate_id', count(*) FROM (SELECT unnest(cs) AS x FROM good) WHERE NOT regexp_full_match(x, 'S[23]-[0-9]+') UNION ALL SELECT 'match_id', count(*) FROM claims WHERE NOT regexp_full_match(x, 'S[23]-[0-9]+')
UNION ALL SELECT 'subset', count(*) FROM claims JOIN good USING (i) WHERE NOT list_contains(cs, x) UNION ALL SELECT 'duplicate_s1', count(*) - count(DISTINCT s) FROM good
UNION ALL SELECT 'one_owner', count(*) FROM claims JOIN (SELECT x, arg_min(s, i) AS first FROM claims GROUP BY 1) USING (x) WHERE s <> first""",
    "list_statistics": """SELECT (SELECT count(*) FROM entities) AS n_s1, (SELECT count(*) FROM scored) AS n_candidates, (SELECT count(*) FROM decoded) AS n_matches,
  (SELECT count(*) FROM entities WHERE s1_id NOT IN (SELECT s1_id FROM scored)) AS no_candidates, (SELECT count(*) FROM entities WHERE s1_id NOT IN (SELECT s1_id FROM decoded)) AS no_matches,
  (SELECT count(*) FROM decoded WHERE left(cand_id, 2) = 'S3') AS n_s3, (SELECT count(*) FROM decoded WHERE left(cand_id, 2) = 'S2') AS n_s2,
  (SELECT count(*) FROM scored WHERE left(cand_id, 2) = 'S2') AS n_candidates_s2, (SELECT count(*) FROM scored WHERE left(cand_id, 2) = 'S3') AS n_candidates_s3, (SELECT count(DISTINCT cand_id) FROM decoded) AS n_unique""",
    "labelled_pairs": "SELECT s.s1_id, s.cand_id, cand_pos, round(p, 6) AS p, (g.s1_id IS NOT NULL)::INT AS y FROM scored s LEFT JOIN gold g ON g.s1_id = s.s1_id AND g.cand_id = s.cand_id",
    "entity_sample": f"SELECT s1_id FROM entities ORDER BY md5(s1_id || ':{CONFIG.seed}'), s1_id LIMIT {SAMPLE}",
    "entity_split": f"SELECT s1_id, {_part(5, CONFIG.seed)} = 0 AS held, ({_part(CONFIG.folds, CONFIG.seed + 1)})::INT AS fold FROM entities",
    "held_out_grid": _grid(_HELD),
    "tau_choice": _TAUS,
    "pruned_candidates": f"{_CONTEXT} SELECT s1_id, cand_id, cand_pos, round(p, 6) AS p, p_rank FROM c WHERE p >= {CONFIG.tau}",
    "stage2_matches": _APPLIED,
    "records_file": "SELECT entity_id, business_name, business_address, coalesce(country, '') AS country FROM records",
    "gold_file": "SELECT s1_id, cand_id FROM gold",
    "index_stage": "SELECT cand_id, key, round(w, 5) AS w FROM idx",
    "list_histogram": """SELECT CASE WHEN c >= 10 THEN '>=10' ELSE c::VARCHAR END AS size, count(*) AS n FROM (SELECT s1_id, count(d.s1_id) AS c FROM entities LEFT JOIN decoded d USING (s1_id) GROUP BY 1) GROUP BY 1""",
}


def _query(plan: Callable[[Derived], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Derived(spark, sf_dir))


QUERIES = {name: _query(plan) for name, plan in PLANS.items()}
SQL = {name: query(select) for name, select in SELECTS.items()}
