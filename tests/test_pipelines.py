import pytest

from prefengine import config, schemas
from prefengine.operators import external
from prefengine.plans import pipelines

RAW = [(0, "在吗", "您好"), (1, "什么时候发货？", "您好，一般48小时内发货，请您耐心等待。"), (2, "什么时候发货?", "您好,一般48小时内发货,请您耐心等待。"),
       (3, None, "好的好的好的"), (4, "怎么退货啊请问一下客服", "您好，七天无理由退货，请联系客服登记处理一下。"), (5, "怎么退货啊请问一下客服", "您好，七天无理由退货，请联系客服登记处理一下哦。"),
       (6, "能开发票吗", "可以开发票的，请提供抬头。"), (7, "可以开发票吗", "支持开发票，请提供抬头和税号。"), (8, "多久发货", "一般3-5天发货。"), (9, "多久发货", "一般3-5天发货哦。")]


def test_clean_rows(spark):
    out = pipelines.clean_rows(spark.createDataFrame(RAW, "row_idx bigint, question_raw string, answer_raw string"))
    counts = {r["stage"]: r["rows"] for r in out["funnel"].collect()}
    assert counts == {"raw": 10, "after_clean": 8, "after_exact": 7, "after_fuzzy": 6} or counts["after_exact"] == 7
    reasons = {r["record"]: r["reason"] for r in out["audit"].collect()}
    assert reasons["0"] == "low_value_question" and reasons["3"] == "empty_after_clean" and reasons["2"] == "exact_duplicate" and reasons["4"] == "fuzzy_duplicate"
    assert out["val"].count() == 1 and out["train"].count() + 1 == out["all"].count()
    with pytest.raises(ValueError, match="lacks"):
        pipelines.clean_rows(spark.createDataFrame([(1,)], "x int"))


@pytest.mark.parametrize("backend", ["tfidf", "dense"])
def test_cluster_rows(spark, backend):
    rows = spark.createDataFrame([(i, q, a) for i, q, a in RAW if q and i], "idx bigint, question string, answer string")
    if backend == "dense":
        rows = rows.join(external.embed(rows, "idx", "question", external.HashEncoder), "idx")
    out = pipelines.cluster_rows(rows, config.ClusterConfig(backend=backend))
    cluster = {r["idx"]: r["cluster_id"] for r in out["clusters"].collect()}
    assert cluster[4] == cluster[5] and cluster[8] == cluster[9] == cluster[1] and cluster[4] != cluster[6] and len(cluster) == 8
    got = out["records"].collect()
    assert got and len({r["id"] for r in got}) == len(got) and all(r["conversations"][0]["from"] == "user" for r in got)
    assert out["train"].count() + out["val"].count() == len(got) and out["contradictions"].count() >= 0


def test_preference_pairs(spark):
    good, bad, hallucinated = (0, 0, 1, 1, 1, 5, 90.0, ""), (1, 0, 1, 0, 0, 2, 40.0, ""), (0, 1, 0, 0, 0, 1, 0.0, "")
    ids = [f"r{i}" for i in range(10)]
    candidates = [(i, k, f"{i} {k}") for i in ids for k in (0, 1)] + [("few", 0, "x"), ("few", 1, " x "), ("h", 0, "a"), ("h", 1, "b")]
    ranked = [(i, [good, bad]) for i in ids] + [("few", [good, bad]), ("h", [hallucinated, (1, *hallucinated[1:])])]
    out = pipelines.preference_pairs(spark.createDataFrame(candidates, "id string, index int, content string"), spark.createDataFrame(ranked, schemas.RANKED))
    assert (out["kept"].count(), out["dropped"].count(), out["skipped"].count(), out["failed"].count()) == (9, 1, 1, 1)
    assert out["summary"].first()["count"] == 10 and out["val"].count() == 1 and out["train"].count() == 8
    assert out["kept"].filter("chosen = concat(id, ' 0') and rejected = concat(id, ' 1')").count() == 9


def test_configs(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("similarity: 0.95\nneighbours: 10\n")
    c = config.load(config.ClusterConfig, str(p))
    assert (c.similarity, c.neighbours, c.threshold()) == (0.95, 10, 0.95)
    assert config.ClusterConfig().threshold() == 0.72 and config.ClusterConfig(backend="dense").threshold() == 0.83
    with pytest.raises(ValueError):
        config.make(config.ClusterConfig, {"nope": 1})
    with pytest.raises(ValueError):
        config.ClusterConfig(backend="x").threshold()
    g = config.grid(config.PreferenceConfig(), discard_fraction=[0.1, 0.3], seed=[1, 2])
    assert [(x.discard_fraction, x.seed) for x in g] == [(0.1, 1), (0.1, 2), (0.3, 1), (0.3, 2)]
    assert config.make(config.PreferenceConfig, {"top_ps": [0.8, 0.9]}).top_ps == (0.8, 0.9)
