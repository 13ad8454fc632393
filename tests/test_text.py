import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefengine.functions import rules, text


def values(spark, data, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


CLEAN = {
    None: "", "": "", "  \n ": "", "你好&nbsp;<b>世界</b>": "你好 世界", "１２３ＡＢＣ": "123ABC", "退货！！！": "退货!", "2024年3月5日发货": "2024-03-05发货",
    "3月5日发货": "03-05发货", "3-5日到": "03-05到", "9:5开始": "09:05开始", "8点开门": "08:00开门", "8点30分开门": "08:30开门", "共1,234.50元": "共1234.50元",
    "1,234,567件": "1234567件", "好的😀谢谢": "好的 谢谢", "a​b": "ab", "坏�字": "坏 字", "《书名》好": "好", "等等…": "等等.", "好。请说": "好。 请说",
    "Hello. World": "Hello.World", "“引”‘用’": "\"引\"'用'", "a\r\nb\tc": "a b c", "12345,678": "12345,678", "99:99": "99:99", "2024/12/31": "2024-12-31", "&amp;amp;": "&",
}


def test_clean_text(spark):
    assert values(spark, CLEAN, text.clean_text) == list(CLEAN.values())


def test_spellings_with_wide_digits(spark):
    assert values(spark, ["１２月３日", "２０２５-１２-３", "９：３０"], lambda c: text.colon_times(text.month_days(text.iso_dates(c)))) == ["１２-0３", "２０２５-１２-３", "0９:３０"]


def test_titles_can_be_kept(spark):
    assert values(spark, ["《书名》好"], lambda c: text.clean_text(c, keep_titles=True)) == ["《书名》好"]


def test_dedup_key_ignores_case_blanks_and_marks(spark):
    keys = values(spark, ["请问 发货吗？", "请问发货吗?", "  请问，发货吗！！", "请问发货吗~"], text.dedup_key)
    assert set(keys) == {"请问发货吗"}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab好，。! 　ＡＢ1", max_size=12), min_size=1, max_size=20))
def test_dedup_key_is_stable(spark, data):
    once = values(spark, data, text.dedup_key)
    assert values(spark, once, text.dedup_key) == once


def test_low_value(spark):
    assert values(spark, ["在吗", "?!", "好", None, "怎么退货", "__"], text.low_value_question) == [True, True, True, True, False, True]
    assert values(spark, ["稍等哈", "可以的", "可以退货的", ""], text.low_value_answer) == [True, True, False, True]


def test_small_scalars(spark):
    assert values(spark, ["<think>a\nb</think> 好 ", "好"], text.strip_thinking) == ["好", "好"]
    assert values(spark, ["亲亲亲", "a", ""], lambda c: text.occurrences(c, "亲亲")) == [1, 0, 0]
    assert values(spark, ["1 22 333 4444", "x"], text.digit_runs) == [3, 0]
    assert values(spark, ["a.b", "a*b"], lambda c: text.contains_any(c, ["*b", "("])) == [False, True]
    assert values(spark, ["x" * 5, "x" * 57, "x" * 900], lambda c: text.length_bucket(c, 20, 200)) == [0, 40, 200]
    assert values(spark, ["x" * 10, "x" * 300], text.target_length) == [90, 220]
    assert values(spark, ["0.05"], text.run_tag) == ["0p05"]
    assert values(spark, ["a"], lambda c: text.filled("<{q}|{r}>", q=c, r=F.lit(None).cast("string"))) == ["<a|>"]


def test_cache_key_is_the_digest_of_canonical_json(spark):
    import hashlib
    import json

    said = 'a "b" \\ \n'
    want = hashlib.sha256(json.dumps({"answer": said, "model": "m"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert values(spark, [said], lambda c: text.cache_key(model=F.lit("m"), answer=c)) == [want]


def test_lenient_json(spark):
    data = ['{"a": 1}', '```json\n{"a": 2}\n```', 'so: {"a": 3} done', '{"a": ', "none", None]
    got = values(spark, data, lambda c: F.try_variant_get(text.lenient_json(c), "$.a", "int"))
    assert got == [1, 2, 3, None, None, None]


def test_number_text(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(text.safe_number(F.col("x"))).collect()] == ["1.5", "", ""]


TOPICS = {"能开发票吗": ["invoice"], "什么时候发货": ["ship_time"], "几天能到": ["delivery_time"], "支持货到付款吗": ["cod"], "有优惠吗": ["money"], "这个好看吗": ["generic"],
          "可以先试用吗": ["yesno_generic"], "速度怎么样": ["time_generic"], "退货和发票": ["invoice", "return"]}


def test_topics(spark):
    assert values(spark, TOPICS, rules.question_topics) == list(TOPICS.values())
    assert values(spark, ["退货和发票"], lambda c: rules.question_type(rules.question_topics(c))) == ["invoice"]


def test_semantic_keys_merge_and_exclude(spark):
    same = ["多久能到", "几天到货呢", "什么时候可以送到", "请问大概多久收到"]
    assert set(values(spark, same, rules.semantic_key)) == {"delivery_time:多久到"}
    assert set(values(spark, ["多久发货", "何时能发出吗"], rules.semantic_key)) == {"ship_time:多久发货"}
    assert set(values(spark, ["最快多久到", "海外多久到", "指定时间多久到", "多久能退款"], rules.semantic_key)) == {None}


def test_stance(spark):
    assert values(spark, ["支持7天无理由退货", "不支持退货", "在路上了", "没有了"], rules.stance) == ["positive", "negative", "unknown", "negative"]


@pytest.mark.parametrize("said, want", [("3-5天到", [(72.0, 120.0)]), ("48小时内发货", [(0.0, 48.0)]), ("2个工作日左右", [(48.0, 48.0)]), ("没有时间", []),
                                        ("６天到", [(144.0, 144.0)]), ("٣天到", []), ("24小时,3至7个工作日以内", [(24.0, 24.0), (72.0, 168.0)])])
def test_time_ranges(spark, said, want):
    assert [tuple(r) for r in values(spark, [said], rules.time_ranges)[0]] == want


def test_ranges_overlap(spark):
    df = spark.createDataFrame([("3-5天", "5-7天"), ("1天", "3-5天"), ("", "1天")], "a string, b string")
    got = [r[0] for r in df.select(rules.ranges_overlap(rules.time_ranges(F.col("a")), rules.time_ranges(F.col("b")))).collect()]
    assert got == [True, False, False]


def test_answer_quality(spark):
    df = spark.createDataFrame([("x" * 60, "generic"), ("支持", "invoice"), ("亲亲", "generic"), ("!" * 5, "generic")], "a string, k string")
    got = [r[0] for r in df.select(rules.answer_quality(F.col("a"), F.col("k"))).collect()]
    assert got == [1.0, pytest.approx(0.275 + 0.08 + 0.15), pytest.approx(0.275 - 0.36), pytest.approx(0.3125 - 0.15, abs=1e-4)]


def test_topics_compatible(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), (["generic"], ["money"]), (["generic"], ["stock"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(rules.topics_compatible(F.col("a"), F.col("b"))).collect()] == [True, True, False]


#: Typed by hand: a question, its topics in order, its semantic key.
TOPIC_ROWS = [
    ("请问多久发货", ["ship_time"], "ship_time:多久发货"), ("什么时候能收到货", ["delivery_time"], "delivery_time:多久到"), ("多久到货", ["delivery_time"], "delivery_time:多久到"),
    ("物流一般几天到", ["delivery_time"], "delivery_time:多久到"), ("你好，订单什么时候发出", ["ship_time"], "ship_time:多久发货"), ("配送速度怎么样", ["delivery_time"], None),
    ("快递快吗", ["delivery_time"], None), ("物流有问题怎么办", ["logistics_issue"], None), ("可以特定的配送时间吗", ["delivery_schedule", "delivery_time"], None),
    ("国际快递多久到", ["international_delivery_time", "delivery_time"], None), ("能开发票吗", ["invoice"], None), ("支持货到付款吗", ["cod"], None),
    ("可以定制化吗", ["custom"], None), ("怎么联系你们", ["contact"], None), ("客服时间是几点", ["service_hours"], None), ("查询物流在哪", ["logistics_query"], None),
    ("包裹损坏了", ["damaged_goods", "logistics_issue"], None), ("能到店自提吗", ["pickup"], None), ("退换货政策是什么", ["return"], None), ("售后怎么样", ["aftersales"], None),
    ("质保几年", ["warranty"], None), ("现货吗", ["stock"], None), ("怎么支付", ["payment"], None), ("更改收货地址", ["address_change"], None),
    ("要等多久", ["time_generic"], None), ("有优惠吗", ["money"], None), ("是不是正品", ["yesno_generic"], None), ("尺寸多大", ["generic"], None), ("", ["generic"], None),
    ("运费怎么算", ["money"], None), ("什么时候补货", ["time_generic"], None), ("几点上班", ["generic"], None), ("付款一直失败", ["generic"], None),
]


def test_topics_of_typed_questions(rows):
    from prefengine.functions import rules

    df = rows([(i, q) for i, (q, *_) in enumerate(TOPIC_ROWS)], "i int, q string")
    topics = rules.question_topics(F.col("q"))
    got = {r["i"]: (r["t"], r["k"], r["y"]) for r in df.select("i", topics.alias("t"), rules.semantic_key(F.col("q")).alias("k"), rules.question_type(topics).alias("y")).collect()}
    for i, (q, want, key) in enumerate(TOPIC_ROWS):
        assert got[i] == (want, key, want[0]), q


def test_topic_files(tmp_path):
    from prefengine.functions import rules

    (tmp_path / "own.txt").write_text("# note\nsize: 尺码 尺码表 大小\n\ncolour:颜色\n", encoding="utf-8")
    assert rules.read_topics(tmp_path / "own.txt") == {"size": ("尺码", "大小"), "colour": ("颜色",)}
    assert list(rules.ZH_SHOP.topics)[:3] == ["invoice", "cod", "custom"] and len(rules.ZH_SHOP.topics) == 19
