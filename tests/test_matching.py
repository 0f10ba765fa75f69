import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.config import Config, pair_grid, single_grid, stage2_grid
from kinlink.functions import indel
from kinlink.operators import blocking, decide, evaluate, model, similarity, validate
from kinlink.sources import files


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def slow_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0

    def best(s, t):
        windows = [t[max(0, k) : k + len(s)] for k in range(1 - len(s), len(t))]
        return max(200.0 * slow_lcs(s, w) / (len(s) + len(w)) for w in windows)

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


short = st.text("abc 1", max_size=9)


@settings(max_examples=300, deadline=None)
@given(short, short)
def test_indel_scorers_against_brute_force(a, b):
    assert indel.lcs(a, b) == slow_lcs(a, b)
    assert indel.ratio(a, b) == pytest.approx(indel.ratio(b, a))
    assert indel.partial_ratio(a, b) == pytest.approx(slow_partial(a, b))
    for f in (indel.ratio, indel.partial_ratio, indel.token_set_ratio, indel.token_sort_ratio):
        assert 0 <= f(a, b) <= 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(short, st.text("abc 1", max_size=90)), max_size=12))
def test_many_partial_ratios_at_once(pairs):
    assert indel.partial_ratios(pairs) == pytest.approx([slow_partial(a, b) for a, b in pairs])


def test_long_partial_ratios():
    for n in (63, 64, 65, 130):
        pairs = [("ab" * n, "ba" * n + "x"), ("a" * n, "b" * n), ("abc" * (n // 3 + 1), "cab" * (n // 3 + 1))]
        pairs = [(a[:n], b[: n + k]) for a, b in pairs for k in (0, 1, 5)]
        assert indel.partial_ratios(pairs) == pytest.approx([slow_partial(a, b) for a, b in pairs])


def test_indel_edges():
    assert indel.ratio("", "") == 100 and indel.token_set_ratio("", "") == 0 and indel.partial_ratio("", "a") == 0
    assert indel.token_set_ratio("a b", "b a c") == 100 and indel.token_sort_ratio("b a", "a b") == 100


def prepared(spark, rows):
    return blocking.prepare(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))


def keys_of(spark, name, address, country="in"):
    rows = blocking.blocking_keys(prepared(spark, [("S1-1", name, address, country)])).collect()
    return sorted(r.key for r in rows)


def test_keys(spark):
    assert keys_of(spark, "", "") == [] and keys_of(spark, None, None, None) == []
    assert keys_of(spark, "Acme", "") == sorted(["in|t|acme", "in|f|acm", "in|p|acme"])
    got = keys_of(spark, "Royal Acme Foods", "450 Church Road 09 275 Temple")
    for k in ("in|p|roya|acme", "in|s|acme|food", "in|d|450|roy", "in|d|275|roy", "in|nn|275|450", "in|nn|450|9", "in|nw|450|chrch", "in|nw|275|tmpl", "in|at|chrch", "in|ap|chrch|rd"):
        assert k in got, k
    assert not any(k.startswith("in|at|rd") for k in got)
    assert any(k.startswith("in|cat|") for k in got)


def test_cap_and_weights(spark):
    keys = spark.createDataFrame([(f"S2-{i}", "full") for i in range(200)] + [(f"S2-{i}", "over") for i in range(201)] + [("S3-1", "rare")], "entity_id string, key string")
    index = {r.key: (r.block_size, r.w) for r in blocking.build_index(keys).collect()}
    assert set(index) == {"full", "rare"}
    assert index["rare"][1] == pytest.approx(math.log(201), rel=1e-6) and index["full"][1] == pytest.approx(math.log(2), rel=1e-6)


def test_cut_is_ranked_before_the_shuffle_and_ties_keep_source_order(spark):
    pairs = spark.createDataFrame([("S1-1", f"S3-{i}", 1.0) for i in range(5)] + [("S1-1", "S2-7", 1.0), ("S1-1", "S2-10", 2.0)], "s1_id string, cand_id string, key_idf double")
    best = blocking.cut(pairs, F.col("key_idf"), 3, *blocking.source_order("cand_id"))
    assert [r.cand_id for r in best.orderBy("cand_pos").collect()] == ["S2-10", "S2-7", "S3-0"]
    plan = best._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def features(spark, a, b):
    rows = prepared(spark, [("S1-1", *a, "x"), ("S3-2", *b, "x")])
    pairs = spark.createDataFrame([("S1-1", "S3-2", 1, 2.0, 1)], "s1_id string, cand_id string, shared_keys long, key_idf float, cand_pos int")
    return similarity.pair_features(blocking.with_strings(pairs, rows, rows)).first()


def test_features_at_their_edges(spark):
    empty = features(spark, ("", ""), ("", ""))
    assert (empty.name_jacc, empty.digit_jacc, empty.addr_contain, empty.first_tok_eq, empty.phon_first_eq, empty.name_empty) == (0, -1, -1, 1, 1, 2)
    assert empty.name_ratio == 100 and empty.name_tset == 0 and empty.is_s3 == 1 and empty.n_cands == 1
    short = features(spark, ("FSP", "50b"), ("Family Select Physicians", "50"))
    assert short.acronym_eq == 1 and short.digit_any == 1 and short.num_shared == 0
    assert set(similarity.FEATURES) < set(empty.asDict()) and len(similarity.FEATURES) == 36


def test_group_ranks_share_ties(spark):
    rows = [("S1-1", f"S2-{i}", v, 0.0, 0.0, 0.0) for i, v in enumerate((90.0, 90.0, 80.0))]
    got = similarity.group_features(spark.createDataFrame(rows, "s1_id string, cand_id string, name_tset double, addr_tset double, phon_tset double, key_idf double"))
    assert [(r.rank_name, r.name_gap, r.n_cands) for r in got.orderBy("cand_id").collect()] == [(1, 0, 3), (1, 0, 3), (3, 10, 3)]


def scored(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "s1_id string, cand_id string, p double, cand_pos int")


def test_context(spark):
    got = {r.cand_id: r for r in decide.context_features(scored(spark, [("S1-1", "S2-1", 0.9), ("S1-1", "S3-1", 0.2), ("S1-2", "S3-1", 0.5)])).collect() if r.s1_id == "S1-1"}
    assert got["S2-1"].p_gap2 == pytest.approx(0.7) and got["S3-1"].p_gap2 == pytest.approx(0.2)
    assert got["S2-1"].p_top2 == 0.2 and got["S2-1"].s2_best == 1 and got["S3-1"].s3_best == 1 and got["S3-1"].s2_best == 0
    assert got["S3-1"].p_share == pytest.approx(0.2 / 1.1)


def test_decisions(spark):
    pairs = scored(spark, [("S1-1", "S2-1", 0.5), ("S1-1", "S2-2", 0.7)])
    assert [r.cand_id for r in decide.decode(pairs, 0.4, 0.8).collect()] == ["S2-2"]
    claims = scored(spark, [("S1-10", "S2-1", 0.9), ("S1-9", "S2-1", 0.9), ("S1-2", "S2-1", 0.8), ("S1-2", "S2-3", 0.1)])
    assert sorted((r.s1_id, r.cand_id) for r in decide.one_owner(claims).collect()) == [("S1-2", "S2-3"), ("S1-9", "S2-1")]


@pytest.mark.parametrize("gold, pred, wanted", [([], [], 1), ([], ["a"], 0), (["a", "b"], ["a"], 1.25 * 0.5 / (0.25 + 0.5)), (["a"], ["b"], 0)])
def test_f05(spark, gold, pred, wanted):
    def pairs(ids):
        return spark.createDataFrame([("S1-1", i) for i in ids], "s1_id string, cand_id string")

    entities = spark.createDataFrame([("S1-1",)], "s1_id string")
    assert decide.macro_f05(entities, pairs(pred), pairs(gold)).first().f05 == pytest.approx(wanted)


def test_threshold_grid_equals_decoding_each(spark):
    pairs = scored(spark, [("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.6), ("S1-2", "S2-3", 0.4), ("S1-3", "S2-4", 0.2)])
    entities = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 6)], "s1_id string")
    gold = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-3"), ("S1-5", "S2-9")], "s1_id string, cand_id string")
    grid = [(0.1, 0.5), (0.5, 0.5), (0.3, 0.95)]
    got = {r.pos: r.f05 for r in decide.threshold_grid(pairs, entities, gold, grid).collect()}
    for i, (a, b) in enumerate(grid):
        assert got[i] == pytest.approx(decide.macro_f05(entities, decide.decode(pairs, a, b), gold).first().f05)
    assert (len(single_grid()), len(pair_grid()), len(stage2_grid())) == (14, 114, 13)


def test_lists_and_files(spark, tmp_path):
    entities = spark.createDataFrame([("S1-2",), ("S1-10",)], "s1_id string")
    pairs = spark.createDataFrame([("S1-10", "S3-2"), ("S1-10", "S2-9"), ("S1-10", "S2-9")], "s1_id string, cand_id string")
    lists = decide.match_lists(entities, pairs)
    files.write_lists(lists, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-2\t\nS1-10\tS2-9,S3-2\n"
    assert sorted(map(tuple, files.read_gold(spark, str(tmp_path / "m")).collect())) == [("S1-10", "S2-9"), ("S1-10", "S3-2")]
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\tmore\nS1-1\t"A" b\t\tIN\tx\n')
    assert files.read_records(spark, str(tmp_path / "s.tsv")).first().asDict() == {"entity_id": "S1-1", "business_name": '"A" b', "business_address": "", "country": "IN"}
    assert not files.is_done(spark, str(tmp_path / "t"))
    made = [files.stage(spark, str(tmp_path / "t"), lambda: entities).count() for _ in range(2)]
    assert made == [2, 2] and files.is_done(spark, str(tmp_path / "t"))


def test_validator(spark):
    def lines(*rows, head):
        return spark.createDataFrame([(i, x) for i, x in enumerate([head, *rows])], "n long, line string")

    good = [validate.HEADERS["candidates"], validate.HEADERS["matches"]]
    c = lines("S1-1\tS2-1,S3-1", "S1-2\tS2-1", "S1-3\t", "bad", "S1-5\tX-1", "S1-1\t", head=good[0])
    m = lines("S1-1\tS2-1", "S1-2\tS2-1,S2-2", "S1-4\t", "S1-4\t", "S1-5\t", "S1-1\t", "S1-7\t", head="wrong")
    got = {r.check: r.n for r in validate.violations(c, m).collect()}
    assert got == {"header": 1, "arity": 1, "alignment": 1, "length": 1, "s1_id": 0, "candidate_id": 1, "match_id": 0, "subset": 1, "duplicate_s1": 1, "one_owner": 1}
    assert validate.messages(c, m).count() == 3 and not validate.is_valid(c, m)
    ok = lines("S1-1\tS2-1", head=good[0]), lines("S1-1\tS2-1", head=good[1])
    assert validate.is_valid(*ok) and validate.statistics(*ok).first().n_unique == 1


def test_files_of_many_parts_validate(spark, tmp_path):
    entities = spark.createDataFrame([(f"S1-{i}",) for i in range(400)], "s1_id string").repartition(7)
    pairs = spark.createDataFrame([(f"S1-{i}", f"S{2 + i % 2}-{i}") for i in range(0, 400, 3)], "s1_id string, cand_id string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, column, of in (("m", "matched_entity_ids", pairs), ("c", "candidate_entity_ids", pairs.unionByName(pairs.selectExpr("s1_id", "'S2-999' AS cand_id")))):
            files.write_lists(decide.match_lists(entities, of, column), str(tmp_path / name))
            files.join_parts(spark, str(tmp_path / name), str(tmp_path / f"{name}.tsv"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "m").glob("part*"))) > 2
    lines = (tmp_path / "m.tsv").read_text().split("\n")
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and lines[-1] == "" and [x.split("\t")[0] for x in lines[1:-1]] == [f"S1-{i}" for i in range(400)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for path in ("m", "m.tsv"):
            got = [r.line for r in files.numbered_lines(spark, str(tmp_path / path)).orderBy("n").collect()]
            assert got == lines[:-1] and sorted(r.n for r in files.numbered_lines(spark, str(tmp_path / path)).collect()) == list(range(401))
        for a, b in (("c", "m"), ("c.tsv", "m.tsv"), ("c", "m.tsv")):
            assert validate.main([str(tmp_path / a), str(tmp_path / b)]) == 0
        assert validate.main([str(tmp_path / "m"), str(tmp_path / "c")]) == 1 and validate.main([str(tmp_path / "no"), str(tmp_path / "c")]) == 1
        assert files.read_gold(spark, str(tmp_path / "m")).count() == 134
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "g.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-2\nS1-2\tS2-3\nS1-1\tS2-4,,S2-5\nS1-3\t\n")
    assert sorted(map(tuple, files.read_gold(spark, str(tmp_path / "g.tsv")).collect())) == [("S1-1", "S2-4"), ("S1-1", "S2-5"), ("S1-2", "S2-3")]


def test_blank_ids_are_violations(spark):
    def lines(head, *rows):
        return spark.createDataFrame([(i, x) for i, x in enumerate([validate.HEADERS[head], *rows])], "n long, line string")

    c, m = lines("candidates", "S1-1\tS2-1,,S2-2", "S1-2\tS2-1"), lines("matches", "S1-1\tS2-1,S2-1", "S1-2\tS2-1,")
    got = {r.check: r.n for r in validate.violations(c, m).collect() if r.n}
    assert got == {"candidate_id": 1, "match_id": 1, "subset": 1, "one_owner": 1}


def test_diagnosis(spark):
    def keys(rows):
        return spark.createDataFrame(rows, "entity_id string, key string")

    gold = spark.createDataFrame([("S1-1", f"S2-{i}") for i in range(4)], "s1_id string, cand_id string")
    others = keys([("S2-0", "a"), ("S2-1", "b"), ("S2-2", "c"), ("S2-8", "c"), ("S2-9", "c")])
    ranked = spark.createDataFrame([("S1-1", "S2-0")], "s1_id string, cand_id string")
    got = evaluate.miss_classes(gold, keys([("S1-1", k) for k in "abc"]), others, ranked, Config(max_block=2))
    assert {r.status: r.n for r in got.collect()} == {"found": 1, "cut by ranking": 1, "key too frequent": 1, "no shared key": 1}


def test_learning_end_to_end(spark):
    rows = []
    for i, j in itertools.product(range(400), range(6)):
        good = j == i % 6
        rows.append((f"S1-{i}", f"S{2 + j % 2}-{i * 10 + j}", j + 1, 0.7 + 0.004 * (i % 50) if good else 0.3 * ((i + j) % 10) / 10, int(good)))
    pairs = spark.createDataFrame(rows, "s1_id string, cand_id string, cand_pos int, p double, y int")
    entities, gold = pairs.select("s1_id").distinct(), pairs.where("y = 1").select("s1_id", "cand_id")
    context = decide.context_features(pairs).persist()
    table = model.choose_tau(context, entities, gold, Config(taus=(0.01, 0.2), folds=2, threads=2), trees=3)
    best = max(r["f05"] for r in table)
    assert [r["tau"] for r in table if r["chosen"]] == [max(r["tau"] for r in table if r["f05"] >= best - 0.001)]
    assert best > decide.macro_f05(entities, gold.limit(0), gold).first().f05
    fitted = model.fit_stage2(context.where("p >= 0.2"), trees=3)
    pruned, matched = model.apply_stage2(model.second(fitted), pairs.drop("y"), 0.2, 0.5)
    assert matched.groupBy("cand_id").count().where("count > 1").count() == 0
    assert matched.join(pruned, ["s1_id", "cand_id"], "left_anti").count() == 0


def test_empty_tables(spark):
    none = prepared(spark, [])
    keys = blocking.blocking_keys(none)
    pairs = blocking.candidate_pairs(keys, blocking.build_index(keys))
    assert similarity.pair_features(blocking.rank_candidates(pairs, none, none)).count() == 0
    assert decide.context_features(pairs.select("s1_id", "cand_id", "cand_pos", F.col("key_idf").cast("double").alias("p"))).count() == 0


def test_batches_of_pairs_score_like_single_pairs_without_a_call_a_pair(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    draw = random.Random(1)
    singles = {k: getattr(indel, k) for k in ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio")}
    for letters, most in (("ab ", 4), ("abc 12", 30), ("abcdefgh  ", 90), ("aé漢字\t b", 20)):
        pairs = [tuple("".join(draw.choices(letters, k=draw.randint(0, most))) for _ in "ab") for _ in range(150)] + [("", ""), ("", "a"), ("a b", "b a c")]
        a, b = (pa.array([p[k] for p in pairs]) for k in (0, 1))
        wanted = {k: np.array([f(*p) for p in pairs], np.float32) for k, f in singles.items()}
        with monkeypatch.context() as patch:
            patch.setattr(indel, "lcs", None)
            if most < 60:  # texts of more than 32 words are scored one by one
                patch.setattr(indel, "ratio", None)
            for kind in singles:
                assert (indel.many(kind, a, b).astype(np.float32) == wanted[kind]).all(), (kind, letters)
    long = [("ab" * 150 + " c", "ba" * 140 + " c"), (" ".join(map(str, range(40))), " ".join(map(str, range(20, 70)))), (None, "x"), ("x" * 300, "x" * 300)]
    for kind, f in singles.items():
        got = indel.many(kind, *(pa.array([p[k] for p in long], pa.string()) for k in (0, 1)))
        assert got == pytest.approx([f(a or "", b or "") for a, b in long]), kind
    assert not len(indel.many("ratio", pa.array([], pa.string()), pa.array([], pa.string())))


def test_token_features_split_texts_once_a_batch_and_not_once_a_pair(spark):
    sides = {f"{s}_{c}": "x 1" for s in "ab" for c in ("core", "addr_n", "phon")}
    plan = similarity.token_features(spark.createDataFrame([{"s1_id": "S1-1", "cand_id": "S2-1"} | sides]))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "regexp_extract_all" not in plan and plan.count("ArrowEvalPython [") <= 2
