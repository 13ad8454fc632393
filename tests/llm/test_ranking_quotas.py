import numpy as np
import pytest
from pyspark.sql import functions as F

from prefengine.llm import quotas, ranking
from tests.conftest import DATA
from tests.oracle import connect, same

SCORES = {"a": 1.0, "b": 1.0, "c": 1.0}


def table(rows, data):
    return rows(data, "s string, i int, a double, b double, c double, place_sum string")


def plain(data, weights, steepness=1.0):
    """The method written out with numpy, all candidates under one judge."""
    x = np.array([r[2:5] for r in data], float)
    lower = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    middle = lower(x)
    mad, mean = lower(np.abs(x - middle)), np.abs(x - middle).mean(axis=0)
    unit = np.where(mad > 0, 1.4826 * mad, 1.2533 * mean)
    z = np.divide(x - middle, unit, out=np.zeros_like(x), where=unit > 0)
    w = np.array(list(weights.values()))
    return np.exp((-np.log1p(np.exp(-steepness * z)) * w).sum(axis=1) / w.sum())


@pytest.mark.parametrize("seed", range(3))
def test_combined_scores_equal_the_method(rows, seed):
    rng = np.random.default_rng(seed)
    data = [(f"s{s}", i, float(rng.integers(0, 2)), float(rng.integers(1, 6)), float(rng.lognormal(3, 2)), "") for s in range(20) for i in range(rng.integers(2, 7))]
    weights = {"a": 1.0, "b": 2.0, "c": 0.5}
    got = {(r["s"], r["i"]): r["combined"] for r in ranking.combined_scores(table(rows, data), "s", "i", weights, steepness=0.7).collect()}
    assert np.allclose([got[r[0], r[1]] for r in data], plain(data, weights, 0.7))


def test_an_outlier_does_not_decide_the_ranking(rows, monkeypatch):
    """Without the median deviation and the logistic the score of the largest range orders all."""
    data = [("x", 0, 1.0, 5.0, 60.0, ""), ("x", 1, 1.0, 4.0, 50.0, ""), ("x", 2, 0.0, 1.0, 1e7, ""), ("x", 3, 1.0, 4.0, 55.0, ""), ("x", 4, 0.0, 2.0, 40.0, "")]

    def best():
        return [r["i"] for r in ranking.ranking(ranking.combined_scores(table(rows, data), "s", "i", SCORES), "s", "i").orderBy("rank").collect()]
    assert best() == [0, 3, 1, 2, 4] or best()[0] == 0
    monkeypatch.setattr(ranking, "bounded_logarithm", lambda value, middle, *_: value - middle)
    assert best()[0] == 2


def test_confirmed_best(rows):
    data = [("x", 0, 0.9, 5.0), ("x", 1, 0.8, 4.0), ("x", 2, 0.7, 9.0), ("y", 0, 0.9, 3.0), ("y", 1, 0.8, 6.0), ("z", 0, 0.9, 3.0), ("z", 1, 0.8, 3.0), ("w", 0, 0.5, 1.5), ("w", 1, 0.5, 2.5)]
    got = sorted(map(tuple, ranking.confirmed_best(rows(data, "s string, i int, combined double, place_sum double"), "s", "i").collect()))
    assert got == [("w", 0, True), ("x", 1, False), ("y", 0, True)]


def test_equal_scores_agree_as_the_ranking_orders_them(rows):
    data = rows([("x", 0, 0.5, 2.5), ("x", 1, 0.5, 1.5), ("y", 0, 0.5, 1.5), ("y", 1, 0.5, 2.5)], "s string, i int, combined double, place_sum double")
    first = {r["s"]: r["i"] for r in ranking.ranking(data, "s", "i").filter("rank = 1").collect()}
    assert first == {"x": 0, "y": 0}
    assert sorted(map(tuple, ranking.confirmed_best(data, "s", "i").collect())) == [("x", 1, False), ("y", 0, True)]


def test_no_query_runs_a_stage_that_decides_nothing(spark, monkeypatch):
    def plan(query):
        return query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()

    def joins_on_values(text):
        return [line for line in text.splitlines() if "Join" in line and "value#" in line]
    assert "percentile_approx" not in plan(ranking.p2_found) and "_judge" not in plan(ranking.p2_found) and joins_on_values(plan(ranking.p2_found))
    assert "percentile_approx" in plan(ranking.p2_ranking) and not joins_on_values(plan(ranking.p2_ranking))
    found, agreement = [{tuple(r) for r in query(spark, DATA).collect()} for query in (ranking.p2_found, ranking.p2_agreement)]
    first = {(r["id"], r["cand_index"]) for r in ranking.p2_ranking(spark, DATA).filter("rank = 1").collect()}
    assert agreement == {(True, len(found & first)), (False, len(found - first))}
    monkeypatch.setattr(ranking, "bounded_logarithm", lambda value, middle, *_: middle - value)  # the worst first
    assert {tuple(r) for r in ranking.p2_agreement(spark, DATA).collect()} != agreement


def test_places(rows):
    data = [("x", 0, 1.0, 1000.0, 5.0, ""), ("x", 1, 0.0, 2000.0, 4.0, ""), ("x", 2, 0.5, 0.0, 3.0, ""), ("y", 0, 1.0, 1.0, 1.0, ""), ("y", 1, 1.0, 1.0, 1.0, "")]
    got = {(r["s"], r["i"]): r["place_sum"] for r in ranking.combined_scores(table(rows, data), "s", "i", SCORES).collect()}
    assert got == {("x", 0): 4.0, ("x", 1): 6.0, ("x", 2): 8.0, ("y", 0): 4.5, ("y", 1): 4.5}


def test_queries_equal_sql(spark):
    con = connect(DATA)
    same(ranking.p2_found(spark, DATA), con, ranking.P2_SQL)
    same(ranking.p2_ranking(spark, DATA), con, ranking.P2_RANKING_SQL)


def test_either_stage_alone_gives_its_part_of_both(rows):
    data = table(rows, [("x", 0, 1.0, 3.0, 5.0, ""), ("x", 1, 1.0, 2.0, -0.0, ""), ("x", 2, 0.0, 2.0, 0.0, ""), ("y", 0, None, 1.0, 1.0, ""), ("y", 1, 2.0, 1.0, 1.0, ""), (None, 0, 1.0, 1.0, 1.0, "")])
    for whole in (True, False):
        both = sorted(map(tuple, ranking.combined_scores(data, "s", "i", SCORES, whole_sets=whole).selectExpr("s", "i", "round(combined, 9)", "place_sum").collect()))
        alone = sorted(map(tuple, ranking.combined_scores(data, "s", "i", SCORES, whole_sets=whole, places=False).selectExpr("s", "i", "round(combined, 9)").collect()))
        sums = sorted(map(tuple, ranking.place_sums(data, "s", "i", list(SCORES), whole_sets=whole).collect()))
        assert len(both) == (3 if whole else 4) and alone == [r[:3] for r in both] and sums == [(*r[:2], r[3]) for r in both]


def test_values_are_standardised_by_judge(rows):
    data = [(f"s{k}", i, float(i + 10 * k), float(100 * i), 1.0, "") for k in range(3) for i in range(5)]
    out = ranking.combined_scores(table(rows, data).withColumn("judge", F.col("s")), "s", "i", SCORES, by=["judge"]).collect()
    assert len({round(r["combined"], 9) for r in out if r["i"] == 4}) == 1 and all(0 < r["combined"] < 1 for r in out)


def test_bad_scores(rows):
    data = [("x", 0, 1.0, None, 5.0, ""), ("x", 1, 1.0, 1.0, 1.0, ""), ("y", 0, float("nan"), 1.0, 1.0, ""), ("y", 1, 1.0, 1.0, 1.0, ""), ("z", 0, 9.0, 1.0, 1.0, ""), ("z", 1, 1.0, 1.0, 1.0, "")]
    bounds = {"a": F.col("a").between(0, 5)}
    assert ranking.combined_scores(table(rows, data), "s", "i", SCORES, bounds).count() == 0
    assert ranking.combined_scores(table(rows, data), "s", "i", SCORES, bounds, whole_sets=False).count() == 3
    assert ranking.combined_scores(table(rows, []), "s", "i", SCORES).count() == 0


def test_raking_meets_all_margins():
    n, at = np.array([10.0, 30, 40, 20, 5]), [np.array([0, 0, 1, 1, 1]), np.array([0, 1, 0, 1, 1]), np.array([0, 1, 1, 0, 1])]
    aims = [np.array([0.7, 0.3]), np.array([0.5, 0.5]), np.array([0.4, 0.6])]
    r = quotas.rake(n, at, aims)
    assert all(np.allclose(np.bincount(p, r, 2), t, atol=1e-6) for p, t in zip(at, aims))
    assert quotas.rake(np.zeros(2), [np.array([0, 1])], [np.ones(2)]).sum() == 0


def test_quotas_never_exceed_the_sample():
    assert quotas.quotas(np.array([0.9, 0.1]), np.array([0, 50.0]), np.array([1000, 1000]), 100).tolist() == [50, 50]
    assert quotas.quotas(np.array([0.5, 0.5]), np.array([80.0, 40]), np.array([1000, 1000]), 60).tolist() == [40, 20]
    rng = np.random.default_rng(3)
    for _ in range(300):
        k = rng.integers(1, 8)
        share, least, supply, rows = rng.dirichlet(np.ones(k)), rng.integers(0, 9, k).astype(float), rng.integers(0, 60, k), int(rng.integers(0, 120))
        q, low = quotas.quotas(share, least, supply, rows), np.minimum(least, supply)
        assert (q <= supply).all() and (q >= 0).all() and q.sum() == min(rows, supply.sum())
        assert low.sum() > rows or (q >= low).all()


def test_the_raked_weights_decide_what_is_drawn(rows, monkeypatch):
    """Half the category comes from each source, as in the corpus; without raking it comes as the category has them."""
    r = rows([(f"a{i}", "a", "s" if i % 10 else "t") for i in range(4000)] + [(f"b{i}", "b", "t" if i % 10 else "s") for i in range(4000)], "id string, kind string, source string")
    targets = rows([("p", "a", 0.9, 0), ("p", "b", 0.1, 0)], "plan string, category string, target_share double, min_rows bigint")

    def share(**how):
        sample, _ = quotas.quota_sample(r, "id", F.col("kind"), [F.col("source")], targets, rows([("p", 500)], "plan string, sample_rows bigint"), **how)
        n = {x["source"]: x["count"] for x in sample.join(r, sample["record"] == r["id"]).groupBy("source").count().collect()}
        return n["t"] / sum(n.values())

    fitted, far = share(), share(max_cells=1)
    assert abs(fitted - 0.5) < 0.08 and abs(far - fitted) < 0.01
    monkeypatch.setattr(quotas, "rake", lambda counts, *_: counts / counts.sum())
    assert share() < 0.25


def test_key_ranges_draw_the_smallest(rows):
    known = rows([(f"r{i}", "a", "s") for i in range(3000)], "record string, category string, margin0 string")
    w, q = rows([("p", "a", "s", 0.001)], "plan string, category string, margin0 string, weight double"), rows([("p", "a", 700)], "plan string, category string, quota bigint")
    got = {buckets: {r["record"] for r in quotas._smallest_keys(known, ["margin0"], w, q, 7, buckets).collect()} for buckets in (1, 64, 4096)}
    assert len(got[1]) == 700 and got[1] == got[64] == got[4096]


def test_quotas_repair_minimums_and_use_supply():
    q = quotas.quotas(np.array([0.5, 0.3, 0.2]), np.array([0, 0, 5.0]), np.array([100, 2, 100]), 20)
    assert q.sum() == 20 and q[1] == 2 and q[2] >= 5 and q[0] > 2 * q[2] - 3
    assert quotas.quotas(np.array([1.0]), np.array([0.0]), np.array([3]), 9).tolist() == [3]
    assert quotas.quotas(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 9).tolist() == []


def records(rows, n=300):
    return rows([(f"r{i}", " A　" if i % 10 < 6 else "b" if i % 10 < 9 else None, "s" if i % 2 else "t", 0) for i in range(n)] + [("r0", " A　", "t", 0)],
                "id string, kind string, source string, drawn int")


def test_sample_and_report(rows):
    targets = rows([("p", "a", 0.5, 1), ("p", "B ", 0.5, 0), ("p", "zz", 0.0, 2), ("q", "a", 1.0, 0)], "plan string, category string, target_share double, min_rows bigint")
    plans = rows([("p", 40), ("q", 500), ("none", 3)], "plan string, sample_rows bigint")
    sample, report = quotas.quota_sample(records(rows), "id", F.col("kind"), [F.col("source")], targets, plans)
    n = {(r["plan"], r["category"]): r["count"] for r in sample.groupBy("plan", "category").count().collect()}
    assert n == {("p", "a"): 20, ("p", "b"): 20, ("q", "a"): 180}
    assert sample.select("plan", "record").distinct().count() == sample.count()
    got = {(r["plan"], r["name"]): (r["supply"], r["drawn"], float(r["gap"])) for r in report.collect()}
    assert got == {("p", "a"): (180, 20, 0), ("p", "B "): (90, 20, 0), ("p", "zz"): (0, 0, 2), ("q", "a"): (180, 180, 320)}
    again, _ = quotas.quota_sample(records(rows), "id", F.col("kind"), [F.col("source")], targets, plans)
    assert set(map(tuple, again.collect())) == set(map(tuple, sample.collect()))


def test_no_records(rows):
    targets = rows([("p", "a", 0.5, 1)], "plan string, category string, target_share double, min_rows bigint")
    sample, report = quotas.quota_sample(records(rows).limit(0), "id", F.col("kind"), [F.col("source")], targets, rows([("p", 4)], "plan string, sample_rows bigint"))
    assert sample.count() == 0 and report.first()["supply"] == 0


def test_clashing_columns_and_conflicting_minimums(rows):
    targets = rows([("p", "a", 0.5, 30, 1, 1, "x"), ("p", "b", 0.5, 30, 1, 1, "x"), ("p", None, 0.1, None, 1, 1, "x")],
                   "plan string, category string, target_share double, min_rows bigint, supply int, sample_rows int, name string")
    sample, report = quotas.quota_sample(records(rows), "id", F.col("kind"), [F.col("source")], targets, rows([("p", 40, 3)], "plan string, sample_rows bigint, target_share int"))
    got = {r["name"]: (r["supply"], r["drawn"], float(r["gap"]), r["conflict"]) for r in report.collect()}
    assert got == {"a": (180, 20, 10, True), "b": (90, 20, 10, True), None: (0, 0, 4, True)} and sample.count() == 40


def test_exact_products(rows):
    r = rows([(f"r{i}", "a", "s") for i in range(28)], "id string, kind string, source string")
    targets = rows([("p", "a", 0.07, 0)], "plan string, category string, target_share double, min_rows bigint")
    _, report = quotas.quota_sample(r, "id", F.col("kind"), [F.col("source")], targets, rows([("p", 400)], "plan string, sample_rows bigint"))
    assert float(report.first()["needed"]) == 28.0
