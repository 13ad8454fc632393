"""Queries over small typed tables, each with the results typed by hand as its SQL.

They cover what SQL cannot compute: cleaning patterns with look-around, Unicode composition, lenient scores, time spans,
sequence similarity, the governance of answer families, and the readers and writers of files.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefengine.functions import rules, text
from prefengine.operators import dedup, external, families, judge, preference, records
from prefengine.plans.lineage import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple[str, str | None]]) -> str:
    return "SELECT said, result FROM (VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in rows) + ") t(said, result)"


def scalar(name: str, f: Callable[[Column], Column], rows: dict[str, str | None]) -> None:
    """A query (said, result) of a text function over typed texts."""
    def run(spark: SparkSession, _: str) -> DataFrame:
        said = spark.createDataFrame([(a,) for a in rows], "said string")
        return said.select("said", f(F.col("said")).cast("string").alias("result"))

    QUERIES[name], SQL[name] = run, _values(list(rows.items()))


def table(sql: str):
    """Registers a query with the SQL that types its rows."""
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f
    return add


# --- text ---------------------------------------------------------------------------------------------------------------

scalar("typed_clean_text", text.clean_text, {
    "": "", "  \n ": "", "你好&nbsp;<b>世界</b>": "你好 世界", "１２３ＡＢＣ": "123ABC", "退货！！！": "退货!", "2024年3月5日发货": "2024-03-05发货", "3月5日发货": "03-05发货",
    "3-5日到": "03-05到", "9:5开始": "09:05开始", "8点开门": "08:00开门", "8点30分开门": "08:30开门", "共1,234.50元": "共1234.50元", "1,234,567件": "1234567件",
    "好的😀谢谢": "好的 谢谢", "a​b": "ab", "坏�字": "坏 字", "《书名》好": "好", "等等…": "等等.", "好。请说": "好。 请说", "“引”‘用’": "\"引\"'用'", "a\r\nb\tc": "a b c",
    "12345,678": "12345,678", "99:99": "99:99", "2024/12/31": "2024-12-31", "&amp;amp;": "&"})
scalar("typed_dates", text.iso_dates, {"2024年3月5日发货": "2024-03-05发货", "2024/12/31": "2024-12-31", "2024.1.2": "2024-01-02", "无": "无"})
scalar("typed_month_days", text.month_days, {"3月5日发货": "03-05发货", "12月31日": "12-31", "无": "无"})
scalar("typed_colon_times", text.colon_times, {"9:5开始": "09:05开始", "99:99": "99:99", "23:59": "23:59"})
scalar("typed_clock_times", text.clock_times, {"8点开门": "08:00开门", "8点30分开门": "08:30开门", "无": "无"})
scalar("typed_numbers", text.plain_numbers, {"共1,234.50元": "共1234.50元", "1,234,567件": "1234567件", "12345,678": "12345,678", "1,23": "1,23"})
scalar("typed_emoji", text.strip_emoji, {"好的😀谢谢": "好的 谢谢", "好": "好"})
scalar("typed_invisible", text.strip_invisible, {"a​b": "ab", "坏�字": "坏 字", "好": "好"})
scalar("typed_marks", text.tidy_marks, {"退货!!!": "退货!", "好": "好"})
scalar("typed_edges", text.strip_edges, {" ,好的! ": "好的", "好": "好", "": ""})
scalar("typed_dedup_keys", text.dedup_key, {"请问 发货吗？": "请问发货吗", "请问发货吗~": "请问发货吗", "ＡＢ c": "abc", "!!": ""})
scalar("typed_low_questions", lambda c: text.low_value_question(c), {"在吗": "true", "?!": "true", "好": "true", "怎么退货": "false"})
scalar("typed_low_answers", lambda c: text.low_value_answer(c), {"稍等哈": "true", "可以的": "true", "可以退货的": "false", "": "true"})
scalar("typed_thinking", text.strip_thinking, {"<think>a\nb</think> 好 ": "好", "好": "好"})
scalar("typed_json", lambda c: F.try_variant_get(text.lenient_json(c), "$.a", "int"), {'{"a": 1}': "1", '```json\n{"a": 2}\n```': "2", 'so: {"a": 3} done': "3", '{"a": ': None, "none": None})

# --- rules --------------------------------------------------------------------------------------------------------------

scalar("typed_topics", lambda c: F.array_join(rules.question_topics(c), ","), {
    "请问多久发货": "ship_time", "什么时候能收到货": "delivery_time", "配送速度怎么样": "delivery_time", "快递快吗": "delivery_time", "物流有问题怎么办": "logistics_issue",
    "可以特定的配送时间吗": "delivery_schedule,delivery_time", "国际快递多久到": "international_delivery_time,delivery_time", "能开发票吗": "invoice", "支持货到付款吗": "cod",
    "怎么联系你们": "contact", "包裹损坏了": "damaged_goods,logistics_issue", "能到店自提吗": "pickup", "退换货政策是什么": "return", "质保几年": "warranty", "现货吗": "stock",
    "要等多久": "time_generic", "有优惠吗": "money", "是不是正品": "yesno_generic", "尺寸多大": "generic", "退货和发票": "invoice,return", "几点上班": "generic"})
scalar("typed_semantic_keys", rules.semantic_key, {"多久能到": "delivery_time:多久到", "几天到货呢": "delivery_time:多久到", "何时能发出吗": "ship_time:多久发货", "最快多久到": None, "海外多久到": None, "多久能退款": None})
scalar("typed_stances", rules.stance, {"支持7天无理由退货": "positive", "不支持退货": "negative", "在路上了": "unknown", "没有了": "negative"})
scalar("typed_time_ranges", lambda c: F.to_json(rules.time_ranges(c)), {
    "3-5天到": '[{"lo":72.0,"hi":120.0}]', "48小时内发货": '[{"lo":0.0,"hi":48.0}]', "2个工作日左右": '[{"lo":48.0,"hi":48.0}]', "没有时间": "[]", "６天到": '[{"lo":144.0,"hi":144.0}]',
    "24小时,3至7个工作日以内": '[{"lo":24.0,"hi":24.0},{"lo":72.0,"hi":168.0}]'})

# --- scores -------------------------------------------------------------------------------------------------------------

_SAID = ("true", "1", '"1"', "1.9", '"1.0"', "2", "-1", '"x"', "false", "null")
scalar("typed_binary_scores", lambda c: preference.binary_score(F.parse_json(c)), dict(zip(_SAID, ("1", "1", "1", "1", None, None, None, None, "0", None))))
scalar("typed_whole_scores", lambda c: preference.whole_score(F.parse_json(c), 1, 5), {"3": "3", '"4"': "4", "5.9": "5", "6": None, "0": None, '"4.0"': None, "true": "1", "null": None})
scalar("typed_overall_scores", lambda c: preference.overall_score(F.parse_json(c)), {"88.12345": "88.1235", '"70"': "70.0", "100": "100.0", "101": None, '"x"': None, "-1": None, "null": None})


@table("""SELECT * FROM (VALUES ('a', 'ok', 0, 1, 202.0::DOUBLE), ('b', 'ok', 1, 0, 25.0::DOUBLE), ('c', 'invalid_scores', NULL, NULL, NULL), ('d', 'all_hallucinated', NULL, NULL, NULL))
  t(id, status, best_index, worst_index, delta)""")
def typed_judged_pairs(spark, d):
    """A severe hallucination loses by the widest margin; else the aligned scores decide; one candidate is none to compare."""
    s = lambda i, h, a, c, r, t, o: (i, h, a, c, r, t, o, "")
    rows = spark.createDataFrame([("a", [s(0, 0, 1, 1, 1, 5, 100.0), s(1, 1, 0, 0, 0, 1, 0.0)]), ("b", [s(0, 0, 1, 0, 1, 4, 50.0), s(1, 0, 1, 1, 1, 4, 50.0)]), ("c", [s(0, 0, 1, 1, 1, 5, 90.0)]), ("d", [s(0, 1, 1, 1, 1, 5, 90.0), s(1, 1, 1, 1, 1, 5, 80.0)])],
                                 "id string, scores array<struct<index:int,hallucination:int,accuracy:int,closure:int,auto_resolve:int,satisfaction:int,overall_score:double,rationale:string>>")
    out = preference.judged_pairs(rows)
    return out.select("id", "status", "best_index", "worst_index", F.round("score_delta", 4).alias("delta"))


# --- similarity and families --------------------------------------------------------------------------------------------

@table("SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, true), (5, true)) t(idx, kept)")
def typed_fuzzy_dedup(spark, d):
    """2 is 1 with one letter more, 4 shares the question of 3 but says something else, 5 has a question of its own."""
    q, a = "请问这款保温杯可以放进洗碗机里清洗吗谢谢您的回答", "可以放进洗碗机清洗水温不要超过六十度请放心使用祝您生活愉快"
    data = [(1, q, a, 9), (2, q, a + "哦", 8), (3, q[:-4] + "多谢店家", "不可以", 7), (4, q[:-4] + "多谢店家", "支持七天无理由退货", 6), (5, "发票怎么开具", a, 5)]
    t = spark.createDataFrame(data, "idx int, q string, a string, r int").withColumn("r", -F.col("r"))
    return dedup.fuzzy_dedup(t.withColumn("r", -F.col("r")), "idx", "q", "a", ["r"])


@table("SELECT * FROM (VALUES ('abcd', 'abcd', 1.0::DOUBLE), ('abcd', 'bcde', 0.75::DOUBLE), ('abc', 'xyz', 0.0::DOUBLE), ('', '', 1.0::DOUBLE)) t(a, b, ratio)")
def typed_sequence_ratios(spark, d):
    t = spark.createDataFrame([("abcd", "abcd"), ("abcd", "bcde"), ("abc", "xyz"), ("", "")], "a string, b string")
    return t.withColumn("ratio", dedup.sequence_ratio("a", "b"))


@table("SELECT * FROM (VALUES (1, 0), (2, 0), (3, 1), (4, 0)) t(i, family)")
def typed_families(spark, d):
    data = [(1, 1, "支持退货请联系客服处理", "支持退货请联系客服处理", "positive"), (1, 2, "支持退货请联系客服", "支持退货请联系客服", "positive"),
            (1, 3, "不支持退货请联系客服", "不支持退货请联系客服", "negative"), (2, 4, "好", "好", "unknown")]
    df = spark.createDataFrame(data, "c bigint, i int, a string, n string, stance string")
    return families.merged_families(df, "c", "i", "a", "n").select("i", F.col("family").cast("int").alias("family"))


def _decided(spark):
    data = [(1, 0, 3, 2.0, "3-5天到", "unknown", "delivery_time"), (1, 1, 2, 1.0, "10-15天到", "unknown", "delivery_time"), (1, 2, 1, 1.0, "4天到", "unknown", "delivery_time"),
            (2, 0, 3, 2.0, "支持发票", "positive", "invoice"), (2, 1, 1, 1.0, "不支持发票", "negative", "invoice"), (2, 2, 1, 0.9, "如果满额不支持", "negative", "invoice"),
            (3, 0, 1, 2.0, "支持", "positive", "invoice"), (3, 1, 1, 1.0, "不支持", "negative", "invoice")]
    df = spark.createDataFrame(data, "c int, family int, support bigint, score double, rep_answer string, stance string, kind string").withColumn("ranges", rules.time_ranges(F.col("rep_answer")))
    return families.contradictions(families.ranked_families(df, "c"), "c", "kind", ["delivery_time"], ["invoice"])


@table("""SELECT * FROM (VALUES (1, 0, NULL), (1, 1, 'non_overlapping_time_ranges'), (1, 2, NULL), (2, 0, NULL), (2, 1, 'policy_conflict:positive->negative'), (2, 2, NULL),
  (3, 0, NULL), (3, 1, NULL)) t(c, family, contradiction)""")
def typed_contradictions(spark, d):
    return _decided(spark).select("c", "family", "contradiction")


@table("SELECT * FROM (VALUES (1, 0, true), (1, 2, false), (2, 0, true), (2, 2, false), (3, 0, true), (3, 1, false)) t(c, family, kept)")
def typed_top_families(spark, d):
    kept, late = families.top_families(_decided(spark), "c", 1)
    return kept.select("c", "family", F.lit(True).alias("kept")).unionByName(late.select("c", "family", F.lit(False).alias("kept")))


@table("SELECT 7 AS c, 3 AS support, 1.4::DOUBLE AS score, 'conditional' AS stance")
def typed_consolidated(spark, d):
    fam = spark.createDataFrame([(7, "pickup", 0, 11, "甲", 2, 1.0, "positive"), (7, "pickup", 1, 12, "乙", 1, 0.5, "unknown")],
                                "c int, kind string, family int, rep bigint, rep_answer string, support bigint, score double, stance string")
    one = families.consolidated(fam, "c", "kind", spark.createDataFrame([("pickup", "如果需要自提请联系客服")], "kind string, text string"))
    return one.select("c", F.col("support").cast("int").alias("support"), F.round("score", 6).alias("score"), "stance")


@table("SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (5.2::DOUBLE, 6.0::DOUBLE, 5.0::DOUBLE), (25.0::DOUBLE, 48.0::DOUBLE, 24.0::DOUBLE), (0.3::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE)) t(hours, up, down)")
def typed_rounded_hours(spark, d):
    t = spark.createDataFrame([(0.0,), (5.2,), (25.0,), (0.3,)], "hours double")
    return t.select("hours", families.rounded_hours(F.col("hours"), True).alias("up"), families.rounded_hours(F.col("hours"), False).alias("down"))


@table("SELECT * FROM (VALUES (1, 27.6::DOUBLE, 72.0::DOUBLE), (2, NULL, NULL)) t(id, lo, hi)")
def typed_hour_windows(spark, d):
    t = spark.createDataFrame([(1, [(0.0, 24.0), (24.0, 72.0), (48.0, 96.0)]), (2, [])], "id int, r array<struct<lo:double,hi:double>>")
    w = families.hour_window(F.col("r"), 0.5)
    return t.select("id", F.round(w["lo"], 6).alias("lo"), w["hi"].alias("hi"))


@table("""SELECT * FROM (VALUES ('cluster_00007_ans_00_q_00', '能自提吗', '甲'), ('cluster_00007_ans_00_q_01', '可以自提吗', '甲')) t(id, question, answer)""")
def typed_records(spark, d):
    fam = spark.createDataFrame([(7, 0, "甲", 2, 1.0, "positive")], "c bigint, family int, rep_answer string, support bigint, score double, stance string")
    variants = spark.createDataFrame([(7, 0, 1, 11, "能自提吗"), (7, 0, 2, 12, "可以自提吗")], "c bigint, family int, place int, i bigint, q string")
    out = families.records_of(variants, fam, "c", "q")
    return out.select("id", F.col("conversations")[0]["value"].alias("question"), F.col("conversations")[1]["value"].alias("answer"))


@table("SELECT * FROM (VALUES (1, 'b'), (2, NULL)) t(id, content)")
def typed_by_index(spark, d):
    t = spark.createDataFrame([(1, 1, [(0, "a"), (1, "b"), (1, "c")]), (2, 7, [(0, "a")])], "id int, k int, items array<struct<index:int,content:string>>")
    return t.select("id", records.by_index(F.col("items"), F.col("k"))["content"].alias("content"))


@table("SELECT * FROM (VALUES (1, NULL), (2, 'wrong_number'), (3, 'wrong_role'), (4, 'empty_content'), (5, 'forbidden_term'), (6, 'no_messages'), (7, 'wrong_number')) t(id, reason)")
def typed_dialogue_reasons(spark, d):
    u, a = ("user", "好"), ("assistant", "好的")
    data = [(1, [u, a, u, a]), (2, [u, a]), (3, [u, u, a, a]), (4, [u, a, u, ("assistant", " ")]), (5, [u, a, u, ("assistant", "加微信")]), (6, None), (7, [u, a, u, a, u])]
    t = spark.createDataFrame(data, "id int, m array<struct<role:string,content:string>>")
    return t.select("id", records.dialogue_reason(F.col("m"), ("微信",)).alias("reason"))


@table("""SELECT * FROM (VALUES (0, 'x', '发货吗', '可以的。 请说', '发货吗', '可以的请说'), (1, 'sample_000001', '好', '', '好', '')) t(place, source_id, question, answer, question_norm, answer_norm)""")
def typed_cleaned_pairs(spark, d):
    data = [(0, "x", [("user", "<b>发货吗</b>"), ("gpt", "可以的。请说")]), (1, None, [("user", "好"), ("gpt", None)]), (2, "y", [("user", "一")]), (3, "z", None)]
    t = spark.createDataFrame(data, "place int, id string, conversations array<struct<from:string,value:string>>")
    return records.cleaned_pairs(t, "place")


@table("SELECT * FROM (VALUES ('a', '甲', '乙', 25.0::DOUBLE, 1, 0, 1, 0)) t(id, chosen, rejected, delta, best_index, worst_index, chosen_closure, rejected_closure)")
def typed_pair_cache(spark, d):
    """b has no second candidate, c no valid scores."""
    s = lambda i, c: (i, 0, 1, c, 1, 4, 50.0, "")
    data = [("a", "问", [(0, "乙"), (1, "甲")], [s(0, 0), s(1, 1)]), ("b", "问", [(0, "乙")], [s(0, 0), s(1, 1)]), ("c", "问", [(0, "乙"), (1, "甲")], [s(0, 0)])]
    t = spark.createDataFrame(data, "id string, prompt string, candidates array<struct<index:int,content:string>>, "
                                    "scores array<struct<index:int,hallucination:int,accuracy:int,closure:int,auto_resolve:int,satisfaction:int,overall_score:double,rationale:string>>")
    b = F.col("ranking_brief")
    return records.pair_cache(t, preference.judged_pairs(t)).select("id", "chosen", "rejected", b["score_delta"].alias("delta"), b["best_index"].alias("best_index"), b["worst_index"].alias("worst_index"),
                                                                    b["chosen_scores"]["closure"].alias("chosen_closure"), b["rejected_scores"]["closure"].alias("rejected_closure"))


@table("SELECT * FROM (VALUES (1, '甲|乙'), (2, '丙')) t(c, variants)")
def typed_first_variants(spark, d):
    t = spark.createDataFrame([(1, 3, "丁"), (1, 0, "甲"), (1, 1, "乙"), (1, 2, "甲"), (2, 5, "丙")], "c int, i int, q string")
    return families.first_variants(t, ["c"], "q", [F.col("i")], 2).select("c", F.array_join("variants", "|").alias("variants"))


@table("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, NULL)) t(id, best)")
def typed_best_checkpoints(spark, d):
    t = spark.createDataFrame([(1, "a", "b", "c"), (2, None, "b", "c"), (3, " ", "", "c"), (4, None, None, None)], "id int, x string, y string, z string")
    return t.select("id", judge.best_checkpoint(F.col("x"), F.col("y"), F.col("z")).alias("best"))


# --- files and caches ---------------------------------------------------------------------------------------------------

def _file(spark: SparkSession, name: str, said: str) -> str:
    """A small file in the shared folder, written through Hadoop's file API."""
    folder = f"{checkpoint_folder(spark)}/typed-files"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(conf).create(path, True)
    out.write(said.encode("utf-8"))
    out.close()
    return f"{folder}/{name}"


@table("SELECT * FROM (VALUES ('1', '好', false), ('2', NULL, false), (NULL, '{broken', true)) t(id, said, broken)")
def typed_json_lines(spark, d):
    from prefengine.sources import files

    path = _file(spark, "a.jsonl", '{"id": "1", "conversations": [{"from": "user", "value": "好"}]}\n\n{broken\n{"id": "2"}\n')
    good, broken = files.read_json_lines(spark, path, files.CONVERSATION)
    return (good.select("id", F.try_element_at("conversations", F.lit(1))["value"].alias("said"), F.lit(False).alias("broken"))
            .union(broken.select(F.lit(None).cast("string"), F.col(broken.columns[0]), F.lit(True))))


@table("SELECT * FROM (VALUES ('1'), ('2')) t(id)")
def typed_json_array(spark, d):
    from prefengine.sources import files

    return files.read_json_array(spark, _file(spark, "infer.json", json.dumps([{"id": "1"}, {"id": "2"}], indent=1)), files.CONVERSATION).select("id")


@table("SELECT * FROM (VALUES (1, '1'), (2, '1'), (2, '2'), (3, '1'), (3, '2')) t(of, id)")
def typed_json_array_limits(spark, d):
    from prefengine.sources import files

    path = _file(spark, "few.json", json.dumps([{"id": "1"}, {"id": "2"}]))
    out = None
    for of, limit in ((0, -1), (1, 1), (2, 2), (3, None)):
        one = files.read_json_array(spark, path, files.CONVERSATION, limit).select(F.lit(of).alias("of"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@table("SELECT true AS in_order, 100 AS rows")
def typed_ordered_lines(spark, d):
    """The files of an ordered write follow each other, and so do the lines within them."""
    from prefengine.sources import files

    path = f"{checkpoint_folder(spark)}/typed-files/ordered"
    files.write_json_lines(spark.range(100).select(F.pmod(F.col("id") * 37, F.lit(100)).alias("id")).repartition(4), path, order=[F.col("id")])
    t = spark.read.text(path).select(F.get_json_object("value", "$.id").cast("int").alias("id"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    each = t.groupBy("file").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at", "id"))).alias("rows"))
    inner = each.select("file", "lo", "hi", "n", (F.transform("rows", lambda x: x["id"]) == F.sort_array(F.transform("rows", lambda x: x["id"]))).alias("ok"))
    whole = inner.agg(F.array_sort(F.collect_list(F.struct("file", "lo", "hi"))).alias("f"), F.sum("n").cast("int").alias("rows"), F.min("ok").alias("ok"))
    return whole.select((F.col("ok") & (F.transform("f", lambda x: x["lo"]) == F.sort_array(F.transform("f", lambda x: x["lo"])))).alias("in_order"), "rows")


@table("SELECT * FROM (VALUES ('train', '1'), ('validation', '1')) t(split, id)")
def typed_splits(spark, d):
    from prefengine.sources import files

    path = _file(spark, "one.jsonl", '{"id": "1"}\n')
    return files.read_splits(spark, {"train": path, "validation": path}, files.CONVERSATION).select("split", "id")


@table("SELECT * FROM (VALUES (1.0::DOUBLE, 0.5::DOUBLE), (2.0::DOUBLE, NULL)) t(step, loss)")
def typed_trainer_state(spark, d):
    from prefengine.sources import files

    path = _file(spark, "state.json", json.dumps({"log_history": [{"step": 1, "loss": 0.5}, {"step": 2, "eval/loss": 0.4}]}))
    return files.read_trainer_state(spark, path).select("step", F.col("values")["loss"].alias("loss"))


@table("SELECT * FROM (VALUES ('a', 'new'), ('b', 'old')) t(k, v)")
def typed_latest_rows(spark, d):
    t = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "old", 1)], "k string, v string, at int")
    return external.latest(t, "k", "at").select("k", "v")


@table("SELECT * FROM (VALUES ('r', 2.0::DOUBLE, 0.4::DOUBLE)) t(run, best_step, best_value)")
def typed_best_step(spark, d):
    t = spark.createDataFrame([("r", 1.0, 0.5), ("r", 2.0, 0.4), ("r", 3.0, None)], "run string, step double, loss double")
    return judge.best_step(t, "run", "step", "loss").select("run", "best_step", "best_value")


