import random

import pytest
from pyspark.sql import functions as F

from prefengine.operators import external, judge, preference, records, rewrite, sampling

SCORE = "array<struct<index:int,hallucination:int,accuracy:int,closure:int,auto_resolve:int,satisfaction:int,overall_score:double>>"


def test_judged_pairs(rows):
    good, vague, wrong, bad = (0, 0, 1, 1, 1, 5, 90.0), (1, 0, 1, 0, 0, 3, 60.0), (2, 0, 0, 0, 0, 1, 10.0), (3, 1, 0, 0, 0, 1, 0.0)
    data = [("a", [good, vague, wrong, bad]), ("b", [good, wrong]), ("c", [good, bad]), ("d", [bad, (4, *bad[1:])]), ("e", [good]), ("f", None), ("g", [good, (1, 0, 2, 1, 1, 5, 9.0)]),
            ("h", [good, (1, *good[1:])]), ("i", [good, (1, 0, 1, 1, 1, 5, float("nan"))]), ("j", [])]
    got = {r["id"]: (r["status"], r["best_index"], r["worst_index"], r["score_delta"]) for r in preference.judged_pairs(rows(data, f"id string, scores {SCORE}")).collect()}
    assert got["a"] == ("ok", 0, 1, pytest.approx(101.8 - 50.2))
    assert got["b"][:3] == ("ok", 0, 2)
    assert got["c"] == ("ok", 0, 3, pytest.approx(201.8))
    assert got["d"][0] == "all_hallucinated"
    assert {got[k][0] for k in "efgij"} == {"invalid_scores"}
    assert got["h"] == ("ok", 0, 1, 0.0)


def test_score_fields_of_model_answers(rows):
    data = ["true", "1.9", '" 1 "', '"1.0"', "2", "null", '"x"', "-1", '"+1"']
    v = rows([(i, x) for i, x in enumerate(data)], "i int, s string").select("i", F.parse_json("s").alias("v")).orderBy("i")
    assert [r[0] for r in v.select(preference.binary_score(F.col("v"))).collect()] == [1, 1, 1, None, None, None, None, None, None]
    assert [r[0] for r in v.select(preference.whole_score(F.col("v"), 1, 5)).collect()] == [1, 1, 1, None, 2, None, None, None, None]
    assert [r[0] for r in v.select(preference.overall_score(F.col("v"))).collect()][1:5] == [1.9, 1.0, 1.0, 2.0]


def test_missing_scores(rows):
    df = rows([([0, 1, 2], [(0,), (2,), (9,)])], "c array<int>, s array<struct<index:int>>")
    assert df.select(preference.missing_scores(F.col("c"), F.col("s"))).first()[0] == [1]


def test_unique_candidates_and_grid(rows):
    df = rows([("a", 0, " x "), ("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("b", 0, None), ("b", 1, "z")], "id string, i int, t string")
    u = preference.unique_candidates(df, "id", "i", "t")
    assert sorted(tuple(r) for r in u.collect()) == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    ok, skipped = preference.enough_candidates(u, "id", 1)
    assert [r["id"] for r in ok.collect()] == ["a"] and [r["n"] for r in skipped.collect()] == [1]
    assert preference.sampling_grid([0.5, 0.7], [0.9, 0.9]) == [(0, 0.5, 0.9), (1, 0.7, 0.9)]
    with pytest.raises(ValueError):
        preference.sampling_grid([0.5, 0.7], [0.9])
    with pytest.raises(ValueError):
        preference.sampling_grid([0.5], [0.9])


def test_weakest_dropped_rounds_half_to_even_and_keeps_ties(rows):
    df = rows([(f"{i:02d}", 1.0 if i < 5 else float(i)) for i in range(25)], "id string, d double")
    out = preference.weakest_dropped(df, "d", "id", 0.1)
    assert sorted(r["id"] for r in out.filter("not kept").collect()) == ["00", "01"]  # 2.5 rounds to 2; ties are kept
    assert preference.weakest_dropped(df, "d", "id", 7).filter("kept").count() == 0
    assert preference.weakest_dropped(df.limit(0), "d", "id").count() == 0


def test_nth_stats(rows):
    rng = random.Random(1)
    v = [round(rng.random() * 10, 1) for _ in range(37)]
    got = preference.nth_stats(rows([(x,) for x in [*v, None]], "x double"), "x", {"p30": 0.3, "p90": 0.9}).first()
    s = sorted(v)
    assert (got["count"], got["p30"], got["p90"]) == (37, s[int(36 * 0.3)], s[int(36 * 0.9)])
    assert got["mean"] == pytest.approx(sum(v) / 37)
    four = preference.nth_stats(rows([(float(i),) for i in range(4)], "x double"), "x", {"a": 0.3, "b": 0.5})
    assert (four.first()["a"], four.first()["b"]) == (0.0, 1.0)
    even = preference.nth_stats(rows([(float(i),) for i in range(4)], "x double"), "x", {"b": 0.5}, half_even=True)
    assert even.first()["b"] == 2.0


def test_rewrite_gate_and_overlay(rows):
    data = [("a", "", "旧的回复"), ("b", "旧的回复 ", "旧的回复"), ("c", "短短", "旧的回复"), ("d", "您的订单今天就会处理好的", "旧的回复"), ("e", "您的订单预计3-5天会到达哦", "旧的回复"),
            ("f", "您好，请您耐心等候一下好吗", "旧的回复"), ("g", "<think>今天</think>您好，请您耐心等候一下", "旧"), ("h", None, "旧")]
    df = rows(data, "id string, new string, old string")
    got = {r[0]: r[1] for r in df.select("id", rewrite.rewrite_reason(F.col("new"), F.col("old"), ("今天",), ("\\d+-\\d+天",))).collect()}
    assert got == {"a": "empty", "b": "unchanged", "c": "too_short", "d": "adds_terms", "e": "adds_patterns", "f": None, "g": None, "h": "empty"}
    out = rewrite.overlaid(rows([("a", "x"), ("b", "y")], "id string, t string"), rows([("a", "z", "m"), ("b", "", "m")], "id string, n string, model string"), "id", "t", "n", ["model"])
    assert {r["id"]: (r["t"], r["rewrite"] and r["rewrite"]["original"]) for r in out.collect()} == {"a": ("z", "x"), "b": ("y", None)}


def test_judge_summary_and_best(rows):
    df = rows([(1, 0, 1, 5), (0, 0, 1, 2), (1, 1, 1, 4)], "accuracy int, auto_resolve int, closure int, satisfaction int")
    r = judge.judge_summary(df).first()
    assert (r["samples"], r["accuracy"], r["accuracy_percent"], r["csat"]) == (3, 0.666667, 66.67, 3.667)
    log = rows([("a", 1, 0.5), ("a", 2, 0.3), ("a", 3, 0.3), ("b", 1, None), ("b", None, 0.1), ("b", 2, 0.9)], "run string, step int, loss double")
    assert {r["run"]: r["best_step"] for r in judge.best_step(log, "run", "step", "loss").collect()} == {"a": 2, "b": 2}
    assert {r["run"]: r["best_step"] for r in judge.best_step(log, "run", "step", "loss", lower_is_better=False).collect()} == {"a": 1, "b": 2}


def test_logs(rows):
    df = rows([(1.0, {"loss": 2.0, "eval/x": 1.0}), (None, {"loss": 1.0}), (2.0, {"lr": 3.0})], "step double, v map<string,double>")
    wide = judge.wide_log(df, "step", "v", ["loss", "eval/x"])
    assert [tuple(r) for r in wide.collect()] == [(1.0, 2.0, 1.0)]
    assert sorted((r["metric"], r["value"]) for r in judge.series(wide, "step", ["loss", "eval_x"]).collect()) == [("eval_x", 1.0), ("loss", 2.0)]


def test_markdown_shows_nulls_as_empty(rows):
    got = judge.markdown_table(rows([(2, None), (1, "x")], "i int, t string"), ["i", "t"], [F.col("i")]).first()[0]
    assert got == "| i | t |\n| --- | --- |\n| 1 | x |\n| 2 |  |"


def test_sampling(rows):
    df = rows([(i, f"c{i % 7}") for i in range(101)], "i bigint, c string")
    s = sampling.split(df, "i", 0.02, 1)
    assert s.filter("split = 'val'").count() == 2 and s.count() == 101
    assert sampling.split(df, "i", 0.1, 1, rounding="ceil").filter("split = 'val'").count() == 11
    assert sampling.split(df.limit(3), "i", 0.01, 1).filter("split = 'val'").count() == 1
    assert sampling.split(df.limit(0), "i", 0.1, 1).count() == 0
    assert sampling.split(df, "i", 0.2, 1).select("i", "split").collect() == sampling.split(df.repartition(5), "i", 0.2, 1).select("i", "split").collect() or \
        set(map(tuple, sampling.split(df, "i", 0.2, 1).select("i", "split").collect())) == set(map(tuple, sampling.split(df.repartition(5), "i", 0.2, 1).select("i", "split").collect()))
    assert sampling.sample(df, "i", 5, 1).count() == 5 and sampling.sample(df, "i", 0, 1).count() == 101
    assert sampling.first_rows(df, ["i"], -1).count() == 0 and sampling.first_rows(df, ["i"], None).count() == 101
    cover = sampling.coverage_sample(df, "i", "c", 0.1, 3)
    assert cover.count() == 10 and cover.select("c").distinct().count() == 7
    per = {r["c"]: r["count"] for r in sampling.cluster_sample(df, "i", "c", 0.1, 2, 3).groupBy("c").count().collect()}
    assert set(per.values()) == {2}


def test_records(rows):
    turns = [("human", "q"), ("gpt", "a")]
    df = rows([("x", turns), ("y", [("system", "s"), ("user", "q")]), ("z", None), ("w", [])], "id string, c array<struct<from:string,value:string>>")
    m = records.to_messages(F.col("c"))
    got = {r["id"]: r for r in df.select("id", m.alias("m"), records.ends_with(m).alias("e"), records.with_system(m, "S").alias("s"), records.reference_of(m).alias("r"),
                                         F.size(records.prompt_of(m)).alias("p"), records.first_turn(m, "user", "-").alias("f")).collect()}
    assert [x["role"] for x in got["x"]["m"]] == ["user", "assistant"] and got["x"]["e"] and not got["y"]["e"] and not got["z"]["e"]
    assert got["x"]["s"][0]["content"] == "S" and got["y"]["s"][0]["content"] == "s"
    assert (got["x"]["r"], got["x"]["p"], got["x"]["f"], got["w"]["f"]) == ("a", 1, "q", "-")


def test_dialogues(rows):
    ok = [("user", "q"), ("assistant", "a"), ("user", "q"), ("assistant", "a")]
    data = [("ok", ok), ("odd", ok[:3]), ("long", ok * 3), ("role", ok[::-1]), ("empty", ok[:3] + [("assistant", " ")]), ("term", ok[:3] + [("assistant", "坏词")]), ("none", None)]
    df = rows(data, "id string, m array<struct<role:string,content:string>>")
    got = {r[0]: r[1] for r in df.select("id", records.dialogue_reason(F.col("m"), ("坏词",))).collect()}
    assert got == {"ok": None, "odd": "wrong_number", "long": "wrong_number", "role": "wrong_role", "empty": "empty_content", "term": "forbidden_term", "none": "no_messages"}
    base = rows([("ok", [("user", "old")]), ("k", [("user", "old")])], "id string, conversations array<struct<from:string,value:string>>")
    out = {r["id"]: r for r in records.with_dialogue(base, df.filter("id = 'ok'"), "id", "m").collect()}
    assert out["ok"]["augmentation_turns"] == 2 and len(out["ok"]["conversations"]) == 4 and not out["k"]["augmented_multi_turn"]


def test_pair_record_and_lookup(rows):
    df = rows([("x", [(0, "a"), (1, "b")])], "id string, s array<struct<index:int,t:string>>")
    got = df.select(*records.pair_record("id", F.array(F.lit("p")), records.by_index(F.col("s"), F.lit(1))["t"], records.by_index(F.col("s"), F.lit(9))["t"], F.lit("r"), [F.lit(1).alias("k")])).first()
    assert got["chosen"][0]["content"] == "b" and got["rejected"][0]["content"] is None
    q = df.select(*records.qa_record(F.lit(7), F.lit("q"), F.lit("a"))).first()
    assert q["id"] == "customer_service_000007"


class Broken:
    def answer(self, request):
        if "bad" in request:
            raise ValueError("no")
        return request.upper()


def test_model_calls(rows):
    df = rows([("1", "x"), ("2", "bad"), ("3", "y")], "id string, q string")
    out = external.ask(df, "id", "q", lambda: Broken(), external.Retry(attempts=2), sleep=lambda s: None)
    got = {r["id"]: (r["ok"], r["response"], r["error"]) for r in out.collect()}
    assert got == {"1": (True, "X", None), "2": (False, None, "ValueError: no"), "3": (True, "Y", None)}
    assert external.Retry(base=1, most=5).wait(1, jitter=0) == 2 and external.Retry(most=5).wait(9, jitter=0) == 5 and external.Retry().wait(0, asked=7) == 7
    assert external.EchoModel().answer("q") == "q" and external.EchoModel(["a", "b"]).answer("q") in "ab"


def test_pending_and_latest(rows):
    a, done = rows([("1",), ("2",)], "id string"), rows([("1",), ("1",)], "id string")
    assert [r[0] for r in external.pending(a, done, "id").collect()] == ["2"]
    cache = rows([("k", 1, "old"), ("k", 2, "new"), ("m", 1, "x")], "k string, at int, v string")
    assert {r["k"]: r["v"] for r in external.latest(cache, "k", "at").collect()} == {"k": "new", "m": "x"}
