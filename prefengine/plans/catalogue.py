"""Queries of the core operators and their SQL.

Every query reads its whole tables.  A query without SQL needs something that SQL lacks (sequence similarity, greedy
scans, look-around patterns, Unicode composition) and is tested against a plain model in tests/.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefengine.functions import rules, text
from prefengine.operators import dedup, external, families, graph, judge, preference, records, rewrite, sampling
from prefengine.plans import goldens
from prefengine.plans import tables as T
from prefengine.plans.lineage import cut
from prefengine.streaming import increments

FLAGSHIP = "clean_funnel"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f
    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | goldens.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | goldens.SQL


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")" if words else "false"


# --- cleaning, filtering, exact and fuzzy de-duplication ------------------------------------------------------------

_REASON = f"""CASE WHEN question = '' OR answer = '' THEN 'empty_after_clean'
  WHEN length({T.core_sql('question')}) < 2 OR {T.core_sql('question')} IN ({_list(text.LOW_VALUE_QUESTIONS)}) OR regexp_full_match({T.core_sql('question')}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+') THEN 'low_value_question'
  WHEN length({T.core_sql('answer')}) < 4 OR {T.core_sql('answer')} IN ({_list(text.LOW_VALUE_ANSWERS)}) OR regexp_full_match({T.core_sql('answer')}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+') THEN 'low_value_answer' END"""
_KEPT = f"""(SELECT *, {T.squeezed_sql('question')} AS q, {T.squeezed_sql('answer')} AS a FROM (SELECT *, {_REASON} AS reason FROM {T.QA}) WHERE reason IS NULL)"""
_DEDUP = f"""(SELECT *, first_value(idx) OVER (PARTITION BY q, a ORDER BY length(answer) DESC, length(question) DESC, idx) AS best FROM {_KEPT})"""


def _kept(t: DataFrame) -> DataFrame:
    t = t.filter(dedup.drop_reason(F.col("question"), F.col("answer")).isNull())
    return t.withColumns({"q": text.squeezed(F.col("question")), "a": text.squeezed(F.col("answer"))})


def _deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep_best(_kept(T.qa(spark, d)), ["q", "a"], [F.length("answer"), F.length("question"), -F.col("idx")], "idx")


@query(f"""SELECT 0 AS at, 'raw' AS stage, count(*) AS rows FROM {T.QA} UNION ALL SELECT 1, 'after_filter', count(*) FROM {_KEPT}
  UNION ALL SELECT 2, 'after_exact_dedup', count(*) FROM {_DEDUP} WHERE best = idx""")
def clean_funnel(spark, d):
    kept = dedup.drop_reason(F.col("question"), F.col("answer")).isNull()
    return dedup.filter_funnel(T.qa(spark, d), kept, [text.squeezed(F.col("question")), text.squeezed(F.col("answer"))])


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM {T.QA}) GROUP BY 1")
def drop_reasons(spark, d):
    reason = F.coalesce(dedup.drop_reason(F.col("question"), F.col("answer")), F.lit("kept"))
    return T.qa(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""SELECT idx, reason FROM (SELECT idx, {_REASON} AS reason, row_number() OVER (PARTITION BY {_REASON} ORDER BY idx) AS pos FROM {T.QA}) WHERE reason IS NOT NULL AND pos <= 20""")
def audit_rows(spark, d):
    t = T.qa(spark, d).withColumn("reason", dedup.drop_reason(F.col("question"), F.col("answer"))).filter("reason is not null")
    return dedup.audit_sample(t, "reason", "idx", 20).select("idx", "reason")


@query(f"SELECT idx, CASE WHEN best <> idx THEN best END AS duplicate_of FROM {_DEDUP}")
def exact_dedup(spark, d):
    return _deduplicated(spark, d).select("idx", "duplicate_of")


@query(f"SELECT least(length(answer) // 20 * 20, 200) AS value, count(*) AS n FROM {T.QA} GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def answer_length_histogram(spark, d):
    return dedup.top_values(T.qa(spark, d), text.length_bucket(F.col("answer"), 20, 200).cast("bigint"))


@query(f"""WITH t AS (SELECT DISTINCT q, least(length(q) // 4, 50) AS band FROM {_DEDUP} WHERE best = idx),
 k AS (SELECT q, 'p:' || band || ':' || left(q, 8) AS block FROM t UNION SELECT q, 's:' || band || ':' || right(q, 8) FROM t)
 SELECT block, count(*) AS texts, count(*) * (count(*) - 1) // 2 AS pairs FROM k GROUP BY 1 HAVING count(*) > 1""")
def block_candidates(spark, d):
    """The blocks of the fuzzy comparison with the pairs that each would give; the pairs themselves are never made."""
    t = _deduplicated(spark, d).filter("duplicate_of is null").select("q").distinct()
    n = F.count("*")
    return (t.select(F.explode(dedup.block_keys("q")).alias("block")).groupBy("block").agg(n.alias("texts"), F.floor(n * (n - 1) / 2).alias("pairs"))
            .filter("texts > 1"))


@query()
def fuzzy_dedup(spark, d):
    t = _kept(T.qa_loaded(spark, d)).select("q", "a", F.length("answer").alias("r1"), F.length("question").alias("r2"), (-F.col("idx")).alias("r3"))
    best = dedup.best_of(t, ["q", "a"], ["r1", "r2", "r3"])
    return dedup.fuzzy_dedup(best.withColumn("idx", -F.col("r3")), "idx", "q", "a", ["r1", "r2", "r3"])


@query()
def clean_text_raw(spark, d):
    """The whole cleaning chain over the rows as typed."""
    t = T.read(spark, d, "sample_raw").select("idx", "question_raw", "answer_raw").distinct()
    out = t.select("idx", text.clean_text(F.col("question_raw")).alias("question"), text.clean_text(F.col("answer_raw")).alias("answer"))
    return out.withColumns({"question_key": text.squeezed(F.col("question")), "answer_key": text.squeezed(F.col("answer"))})


@query()
def time_spellings(spark, d):
    """Dates, times and numbers in one spelling."""
    c = F.col("answer_raw")
    t = T.read(spark, d, "sample_raw").select("idx", "answer_raw").distinct()
    return t.select("idx", text.plain_numbers(text.clock_times(text.colon_times(text.month_days(text.iso_dates(c))))).alias("answer"))


@query("SELECT doc_id, length(regexp_replace(text, '<[^>]+>', ' ', 'g')) AS n, length(text) - length(replace(text, '的', '')) AS hits FROM documents WHERE text IS NOT NULL")
def tags_stripped(spark, d):
    t = T.read(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.length(text.strip_tags(F.col("text"))).cast("bigint").alias("n"), text.occurrences(F.col("text"), "的").cast("bigint").alias("hits"))


# --- rule classification --------------------------------------------------------------------------------------------

_PACK = rules.ZH_SHOP


def _topic_sql(c: str) -> str:
    hits = []
    for t, phrases in _PACK.topics.items():
        hit = _any(c, phrases)
        for name, first, second in _PACK.compound:
            if name == t:
                hit = f"({hit} OR ({_any(c, first)} AND {_any(c, second)}))"
        hits.append(f"CASE WHEN {hit} THEN '{t}' END")
    other = f"'{_PACK.default}'"
    for t, hints in reversed(_PACK.fallback):
        other = f"CASE WHEN {_any(c, hints)} THEN '{t}' ELSE {other} END"
    found = f"list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL)"
    return f"(CASE WHEN len({found}) > 0 THEN {found} ELSE [{other}] END)"


_TOPICS = _topic_sql("question")


@query(f"SELECT idx, array_to_string({_TOPICS}, ',') AS topics, {_TOPICS}[1] AS question_type FROM {T.QA}")
def question_topics(spark, d):
    topics = rules.question_topics(F.col("question"))
    t = T.qa(spark, d).withColumn("t", topics)
    return t.select("idx", F.array_join("t", ",").alias("topics"), rules.question_type(F.col("t")).alias("question_type"))


@query(f"SELECT {_TOPICS}[1] AS question_type, count(*) AS n FROM {T.QA} GROUP BY 1")
def question_type_counts(spark, d):
    kind = rules.question_type(rules.question_topics(F.col("question")))
    return T.qa(spark, d).groupBy(kind.alias("question_type")).agg(F.count("*").alias("n"))




def _stance_sql(c: str) -> str:
    for word, by in _PACK.neutralised:
        c = f"replace({c}, '{word}', '{by}')"
    return "(" + f"CASE WHEN {_any(c, _PACK.negative)} THEN 'negative' WHEN {_any(c, _PACK.positive)} THEN 'positive' ELSE 'unknown' END" + ")"


@query(f"SELECT idx, {_stance_sql('answer')} AS stance FROM {T.QA}")
def answer_stance(spark, d):
    return T.qa(spark, d).select("idx", rules.stance(F.col("answer")).alias("stance"))


@query()
def answer_time_ranges(spark, d):
    return T.qa(spark, d).select("idx", F.to_json(rules.time_ranges(F.col("answer"))).alias("ranges"))


def _semantic_sql(c: str) -> str:
    s = f"regexp_replace({T.squeezed_sql(c)}, '^(?:{'|'.join(_PACK.greetings)})', '')"
    for word in _PACK.dropped_nouns:
        s = f"replace({s}, '{word}', '')"
    for word, by in _PACK.replaced:
        s = f"replace({s}, '{word}', '{by}')"
    return f"regexp_replace({s}, '{_PACK.particles}', '', 'g')"


@query(f"""SELECT idx, CASE WHEN list_has_any(t, [{_list(_PACK.no_key_topics)}]) OR {_any('question', _PACK.no_key_words)} THEN NULL
  {' '.join(f"WHEN list_contains(t, '{k}') AND s = '{w}' THEN '{k}:{w}'" for k, w in _PACK.keys)} END AS semantic_key
  FROM (SELECT idx, question, {_TOPICS} AS t, {_semantic_sql('question')} AS s FROM {T.QA})""")
def semantic_keys(spark, d):
    return T.qa(spark, d).select("idx", rules.semantic_key(F.col("question")).alias("semantic_key"))


def _quality_sql(c: str, kind: str) -> str:
    def hits(words):
        return "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"
    filler = "(" + " + ".join(f"((length({c}) - length(replace({c}, '{w}', ''))) // {len(w)})" for w in _PACK.filler) + ")"
    digits = f"(least(len(regexp_extract_all({c}, '[0-9]+')), 3) * 0.05::DOUBLE)"
    loud = f"(CASE WHEN length({c}) - length(replace({c}, '!', '')) + length({c}) - length(replace({c}, '~', '')) > 3 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)"
    fits = (f"(CASE WHEN {kind} IN ({_list(_PACK.timed_types)}) AND ({digits} > 0 OR contains({c}, '具体') OR contains({c}, '请')) THEN 0.15::DOUBLE "
            f"WHEN {kind} IN ({_list(_PACK.stance_types)}) AND {_stance_sql(c)} <> 'unknown' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)")
    return (f"round(1.0::DOUBLE - least(abs(length({c}) - 60) / 80.0::DOUBLE, 1.0::DOUBLE) + {hits(_PACK.useful)} * 0.08::DOUBLE + {digits} + {fits} "
            f"- {filler} * 0.12::DOUBLE - {hits(_PACK.risky)} * 0.25::DOUBLE - {loud}, 4)")


_SCORED = f"(SELECT idx, answer, {_TOPICS}[1] AS kind FROM {T.QA})"


@query(f"SELECT idx, kind, round(10000 * {_quality_sql('answer', 'kind')})::INT AS quality_points FROM {_SCORED}")
def answer_quality(spark, d):
    t = T.qa(spark, d).withColumn("kind", rules.question_type(rules.question_topics(F.col("question"))))
    return t.select("idx", "kind", F.round(rules.answer_quality(F.col("answer"), F.col("kind")) * 10000).cast("int").alias("quality_points"))


# --- vectors, components, sparse similarity -------------------------------------------------------------------------

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _vectors(spark, d):
    return T.read(spark, d, "embeddings").select("vec_id", "embedding")


@query(f"SELECT a.vec_id AS src, b.vec_id AS dst, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.35")
def similar_vectors(spark, d):
    return graph.similar_vectors(_vectors(spark, d), "vec_id", "embedding", 0.35).withColumn("score", F.round("score", 6))


_KNN = f"""(SELECT src, dst FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS pos
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_COS} >= 0.35) WHERE pos <= 24)"""


@query(f"SELECT src, dst FROM {_KNN}")
def knn_edges(spark, d):
    return graph.knn_graph(_vectors(spark, d), "vec_id", "embedding", 0.35).select("src", "dst")


@query(f"""SELECT src, dst FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS pos
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND {_COS} >= -1) WHERE pos <= 10""")
def nearest_vectors(spark, d):
    """The ten nearest of all rows for every row whose id is divisible by 50."""
    t = _vectors(spark, d)
    return graph.nearest(t.filter("vec_id % 50 = 0"), t, "vec_id", "embedding", 10, -1.0).select("src", "dst")


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {_KNN} UNION SELECT dst, src FROM {_KNN}),
  r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.node WHERE r.root < e.dst),
  c AS (SELECT node, min(root) AS component FROM r GROUP BY node), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1)
  SELECT node, component, size, row_number() OVER (ORDER BY size DESC, component) - 1 AS cluster_id FROM c JOIN s USING (component)""".replace(
      "row_number() OVER (ORDER BY size DESC, component) - 1 AS cluster_id", "dense_rank() OVER (ORDER BY size DESC, component) - 1 AS cluster_id"))
def knn_components(spark, d):
    t = _vectors(spark, d)
    parts = cut(graph.connected_components(t, graph.knn_graph(t, "vec_id", "embedding", 0.35), "vec_id"))
    return parts.join(graph.number_clusters(parts), "component").select("node", "component", "size", F.col("cluster_id").cast("bigint").alias("cluster_id"))


@query(f"""SELECT idx, first_value(idx) OVER (PARTITION BY {T.squeezed_sql('question')} ORDER BY idx) AS component FROM {T.QA}""")
def key_components(spark, d):
    t = T.qa(spark, d).withColumn("k", text.squeezed(F.col("question")))
    edges = graph.key_edges(t, "idx", F.col("k"))
    return graph.connected_components(t, edges, "idx").select(F.col("node").alias("idx"), "component")


_TFIDF = """(WITH g AS (SELECT item_id, substr(lower(text), i, n) AS gram, count(*) AS tf FROM eval_items, range(2, 5) r(n), range(1, 100000) s(i)
    WHERE i <= length(text) - n + 1 GROUP BY ALL),
  f AS (SELECT gram, count(*) AS df FROM g GROUP BY 1),
  w AS (SELECT item_id, gram, tf * (ln((1 + t.n)::DOUBLE / (1 + df)) + 1) AS w FROM g JOIN f USING (gram), (SELECT count(*) AS n FROM eval_items) t)
  SELECT item_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM w)"""


@query(f"SELECT item_id, count(*) AS grams, round(max(weight), 5) AS top_weight FROM {_TFIDF} GROUP BY 1")
def tfidf_items(spark, d):
    w = graph.char_tfidf(T.read(spark, d, "eval_items"), "item_id", "text")
    return w.groupBy("item_id").agg(F.count("*").alias("grams"), F.round(F.max("weight"), 5).alias("top_weight"))


@query(f"""WITH t AS MATERIALIZED (SELECT * FROM {_TFIDF}), s AS (SELECT a.item_id AS q, b.item_id AS r, sum(a.weight * b.weight) AS score FROM t a JOIN t b USING (gram)
  WHERE a.item_id <> b.item_id GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= 0.3)
  SELECT q, r, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, r) AS pos FROM s) WHERE pos <= 24""")
def tfidf_neighbours(spark, d):
    w = cut(graph.char_tfidf(T.read(spark, d, "eval_items"), "item_id", "text"))
    q, r = w.withColumnRenamed("item_id", "q"), w.withColumnRenamed("item_id", "r")
    return graph.sparse_matches(q, r, "q", "r", 0.3, 25).filter("q != r").withColumn("score", F.round("score", 5))


# --- clusters and answer families -----------------------------------------------------------------------------------

@query(f"""SELECT cluster_id, id, question FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, abs(length(question) - 12), length(question) DESC, id) AS pos
  FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id, norm) AS n FROM {T.CLUSTERED})) WHERE pos = 1""")
def canonical_questions(spark, d):
    t = T.clustered(spark, d).withColumn("num", F.regexp_extract("id", "(\\d+)$", 1).cast("bigint"))
    best = families.canonical_questions(t, "cluster_id", "num", "question", "norm")
    return best.join(t.select("cluster_id", "num", "id"), ["cluster_id", "num"]).select("cluster_id", "id", "question")


def _families(spark, d):
    t = T.clustered(spark, d).withColumn("num", F.regexp_extract("id", "(\\d+)$", 1).cast("bigint"))
    t = t.withColumn("kind", rules.question_type(rules.question_topics(F.col("question"))))
    t = families.scored_answers(t.select("cluster_id", "num", "question", "answer", "norm", "answer_norm", "kind"), "answer", "kind")
    t = cut(t)
    merge, apart = families.split_paths(t, "cluster_id", "kind", ["ship_time", "delivery_time", "international_delivery_time", "pickup", "damaged_goods"])
    merged = families.merged_families(merge, "cluster_id", "num", "answer", "answer_norm").withColumn("bonus", F.lit(True))
    return cut(merged.unionByName(families.singleton_families(apart, "cluster_id", "num").withColumn("bonus", F.lit(False))))


@query()
def answer_families(spark, d):
    return _families(spark, d).select("cluster_id", "num", "family")


@query()
def family_decisions(spark, d):
    """Every family with rank, contradiction and whether it is among the two kept."""
    t = _families(spark, d)
    f = (families.family_table(t.filter("bonus"), "cluster_id", "num", "answer")
         .unionByName(families.family_table(t.filter("not bonus"), "cluster_id", "num", "answer", bonus=False)))
    kinds = t.groupBy("cluster_id").agg(F.min_by("kind", "num").alias("kind"))
    ranked = families.ranked_families(f.join(kinds, "cluster_id"), "cluster_id")
    judged = families.contradictions(ranked, "cluster_id", "kind", ["ship_time", "delivery_time", "time_generic"], list(_PACK.stance_types))
    kept, _ = families.top_families(judged, "cluster_id")
    return (judged.join(kept.select("cluster_id", "family", F.lit(True).alias("kept")), ["cluster_id", "family"], "left")
            .select("cluster_id", "family", "support", "rank", "contradiction", F.coalesce("kept", F.lit(False)).alias("kept")))


_SCORED_CLUSTERS = f"""(SELECT *, {_quality_sql('answer', 'kind')} AS quality FROM (SELECT *, {_TOPICS}[1] AS kind FROM {T.CLUSTERED}))"""


@query(f"""SELECT cluster_id, id, place FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY quality DESC, length(answer) DESC, id) AS place
  FROM {_SCORED_CLUSTERS}) WHERE place <= 2""")
def top_answers(spark, d):
    """The two best answers of each cluster when every answer is a family of its own."""
    from pyspark.sql import Window as W

    t = T.clustered(spark, d).withColumn("kind", rules.question_type(rules.question_topics(F.col("question"))))
    t = families.scored_answers(t, "answer", "kind")
    order = W.partitionBy("cluster_id").orderBy(F.desc("quality"), F.desc(F.length("answer")), "id")
    return t.withColumn("place", F.row_number().over(order)).filter("place <= 2").select("cluster_id", "id", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH c AS (SELECT * FROM {T.CLUSTERED}), n AS (SELECT *, count(*) OVER (PARTITION BY cluster_id, norm) AS n FROM c),
  k AS (SELECT cluster_id, norm, id, question FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, abs(length(question) - 12), length(question) DESC, id) AS pos FROM n) WHERE pos = 1),
  o AS (SELECT c.cluster_id, c.id, c.question, row_number() OVER (PARTITION BY c.cluster_id, c.norm ORDER BY length(c.question), c.id) AS pos FROM c JOIN k USING (cluster_id) WHERE c.norm <> k.norm),
  v AS (SELECT cluster_id, id, question, 0 AS late FROM k UNION ALL SELECT cluster_id, id, question, 1 FROM o WHERE pos = 1)
  SELECT cluster_id, place, id, question FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY late, length(question), id) AS place FROM v) WHERE place <= 4""")
def question_variants(spark, d):
    t = T.clustered(spark, d).withColumn("num", F.regexp_extract("id", "(\\d+)$", 1).cast("bigint")).withColumn("family", F.lit(0))
    best = families.canonical_questions(t, "cluster_id", "num", "question", "norm")
    v = families.question_variants(t, "cluster_id", "num", "question", "norm", best)
    return v.join(t.select("cluster_id", "num", "id"), ["cluster_id", "num"]).select("cluster_id", F.col("place").cast("bigint").alias("place"), "id", "question")


@query(f"""SELECT cluster_id, array_to_string(list(s ORDER BY id, p), ',') AS ids FROM (SELECT cluster_id, id, s, p, row_number() OVER (PARTITION BY cluster_id ORDER BY id, p) AS pos
  FROM (SELECT cluster_id, id, unnest(source_ids) AS s, generate_subscripts(source_ids, 1) AS p FROM {T.CLUSTERED})) WHERE pos <= 20 GROUP BY 1""")
def first_source_ids(spark, d):
    t = T.clustered(spark, d).select("cluster_id", "id", F.posexplode("source_ids").alias("p", "s"))
    return families.first_ids(t, ["cluster_id"], "s", [F.col("id"), F.col("p")]).select("cluster_id", F.array_join("ids", ",").alias("ids"))


@query(f"""SELECT cluster_id, count(*) AS records, count(DISTINCT norm) AS questions, count(DISTINCT answer_norm) AS answers FROM {T.CLUSTERED} GROUP BY 1""")
def cluster_sizes(spark, d):
    return T.clustered(spark, d).groupBy("cluster_id").agg(F.count("*").alias("records"), F.countDistinct("norm").alias("questions"), F.countDistinct("answer_norm").alias("answers"))


@query(f"""SELECT count(*) AS clusters, count_if(n > 1) AS multi_record, sum(n)::BIGINT AS records, max(n) AS largest FROM (SELECT count(*) AS n FROM {T.CLUSTERED} GROUP BY cluster_id)""")
def cluster_statistics(spark, d):
    s = T.clustered(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("multi_record"), F.sum("n").alias("records"), F.max("n").alias("largest"))


# --- samples and splits ---------------------------------------------------------------------------------------------

def _ids(spark, d):
    return T.read(spark, d, "sft_train").select("id", F.coalesce("source", F.lit("?")).alias("source")).distinct()


_IDS = "(SELECT DISTINCT id, coalesce(source, '?') AS source FROM sft_train)"


def _hash(seed: int, c: str = "id") -> str:
    return f"sha256('{seed}:' || {c})"


@query(f"""SELECT id, CASE WHEN pos <= greatest(1, floor(n * 0.02)) THEN 'val' ELSE 'train' END AS split FROM (SELECT id, row_number() OVER (ORDER BY {_hash(42)}, id) AS pos, count(*) OVER () AS n FROM {_IDS})""")
def split_train_val(spark, d):
    return sampling.split(_ids(spark, d), "id", 0.02, 42).select("id", "split")


@query(f"""SELECT id, CASE WHEN pos <= ceil(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM (SELECT id, row_number() OVER (ORDER BY {_hash(7)}, id) AS pos, count(*) OVER () AS n FROM {T.PAIRS})""")
def split_pairs(spark, d):
    return sampling.split(T.pairs(spark, d).select("id"), "id", 0.1, 7, rounding="ceil").select("id", "split")


@query(f"SELECT id FROM {_IDS} ORDER BY {_hash(5)}, id LIMIT 300")
def sample_prompts(spark, d):
    return sampling.sample(_ids(spark, d), "id", 300, 5).select("id")


@query(f"""SELECT id FROM (SELECT *, row_number() OVER (ORDER BY r, {_hash(12, 'source')}, id) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_hash(11)}, id) AS r,
  count(*) OVER () AS n FROM {_IDS})) WHERE pos <= round_even(n * 0.3, 0)""")
def coverage_sample(spark, d):
    return sampling.coverage_sample(_ids(spark, d), "id", "source", 0.3, 11).select("id")


@query(f"""SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_hash(3)}, id) AS r, count(*) OVER (PARTITION BY source) AS n FROM {_IDS})
  WHERE r <= least(n, greatest(2, round_even(n * 0.25, 0)))""")
def cluster_ratio_sample(spark, d):
    return sampling.cluster_sample(_ids(spark, d), "id", "source", 0.25, 2, 3).select("id", "source")


@query(f"SELECT idx FROM {T.QA} ORDER BY idx LIMIT 20")
def preview(spark, d):
    return sampling.first_rows(T.qa(spark, d), ["idx"], 20).select("idx")


# --- records --------------------------------------------------------------------------------------------------------

@query(f"""SELECT id, len(messages) AS turns, messages[1].role AS first_role, messages[-1].role AS last_role, coalesce(messages[-1].role = 'assistant', false) AS usable FROM {T.CONVERSATIONS}""")
def conversation_shapes(spark, d):
    m = F.col("messages")
    return T.conversations(spark, d).select("id", F.when(m.isNotNull(), F.size(m)).cast("bigint").alias("turns"), F.try_element_at(m, F.lit(1))["role"].alias("first_role"),
                                            F.try_element_at(m, F.lit(-1))["role"].alias("last_role"), records.ends_with(m).alias("usable"))


_SYSTEM = "你是一名客服。"


@query(f"""SELECT id, len(p) - 1 AS prompt_messages, p[1].content AS system, p[-1].content AS reference FROM (SELECT id, CASE WHEN messages[1].role IS NOT DISTINCT FROM 'system' THEN messages
  ELSE list_concat([{{'role': 'system', 'content': '{_SYSTEM}'}}], messages) END AS p FROM {T.CONVERSATIONS} WHERE messages[-1].role = 'assistant')""")
def prompt_and_reference(spark, d):
    t = T.conversations(spark, d).filter(records.ends_with(F.col("messages"))).withColumn("m", records.with_system(F.col("messages"), _SYSTEM))
    return t.select("id", F.size(records.prompt_of(F.col("m"))).cast("bigint").alias("prompt_messages"), F.try_element_at("m", F.lit(1))["content"].alias("system"),
                    records.reference_of(F.col("m")).alias("reference"))


_FORBIDDEN = ("作为AI", "语言模型", "无法回答")


@query(f"""SELECT id, CASE WHEN messages IS NULL THEN 'no_messages' WHEN len(messages) NOT BETWEEN 4 AND 8 OR len(messages) % 2 <> 0 THEN 'wrong_number'
  WHEN NOT coalesce(list_bool_and([messages[i].role IS NOT DISTINCT FROM (CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END) for i in range(1, len(messages) + 1)]), true) THEN 'wrong_role'
  WHEN list_bool_or([trim(coalesce(m.content, '')) = '' for m in messages]) THEN 'empty_content'
  WHEN list_bool_or([{_any('m.content', _FORBIDDEN)} for m in messages]) THEN 'forbidden_term' END AS reason FROM {T.CONVERSATIONS}""")
def dialogue_validation(spark, d):
    return T.conversations(spark, d).select("id", records.dialogue_reason(F.col("messages"), _FORBIDDEN).alias("reason"))


@query(f"""SELECT id, array_to_string([i || '. ' || coalesce(messages[i].role, '') || ': ' || coalesce(messages[i].content, '') for i in range(1, len(messages) + 1)], chr(10)) AS lines,
  sha256('{{"answer": "' || replace(replace(replace(coalesce(messages[-1].content, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '", "model": "m"}}') AS key FROM {T.CONVERSATIONS} WHERE len(messages) > 0""")
def message_lines(spark, d):
    m = F.col("messages")
    return T.conversations(spark, d).filter(F.size(m) > 0).select("id", text.messages_text(m).alias("lines"), text.cache_key(answer=records.reference_of(m), model=F.lit("m")).alias("key"))


@query(f"""SELECT split, avg(multi::INT) AS share, count(*) AS n, max(turns) AS most FROM (
  SELECT 'train' AS split, id, any_value(len(conversations)) > 3 AS multi, any_value(len(conversations)) AS turns FROM sft_train WHERE conversations IS NOT NULL GROUP BY id
  UNION ALL SELECT 'held_out', id, any_value(len(conversations)) > 3, any_value(len(conversations)) FROM sft_val WHERE conversations IS NOT NULL GROUP BY id) GROUP BY 1""")
def multi_turn_share(spark, d):
    out = None
    for name, table in (("train", "sft_train"), ("held_out", "sft_val")):
        t = T.read(spark, d, table).filter("conversations is not null").select(F.lit(name).alias("split"), "id", F.size("conversations").cast("bigint").alias("turns")).distinct()
        out = t if out is None else out.unionByName(t)
    return out.groupBy("split").agg(F.avg((F.col("turns") > 3).cast("int")).alias("share"), F.count("*").alias("n"), F.max("turns").alias("most"))


# --- candidates, rankings, pairs ------------------------------------------------------------------------------------

_CANDIDATES = f"(SELECT id, 0 AS i, chosen AS content FROM {T.PAIRS} UNION ALL SELECT id, 1, rejected FROM {T.PAIRS} UNION ALL SELECT id, 2, reference FROM {T.PAIRS})"


def _candidates(spark, d):
    t = T.pairs(spark, d)
    return t.select("id", F.posexplode(F.array("chosen", "rejected", "reference")).alias("i", "content"))


_UNIQUE = f"""(SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS i, content FROM (SELECT id, c AS content, min(i) AS o FROM (
  SELECT id, i, regexp_replace(content, '^[{T._SP}]+|[{T._SP}]+$', '', 'g') AS c FROM {_CANDIDATES}) WHERE c <> '' GROUP BY ALL))"""


@query(f"SELECT id, i, content FROM {_UNIQUE}")
def unique_candidates(spark, d):
    return preference.unique_candidates(_candidates(spark, d), "id", "i", "content").withColumn("i", F.col("i").cast("bigint"))


@query(f"SELECT id, count(*) AS n, 'low_diversity' AS reason FROM {_UNIQUE} GROUP BY 1 HAVING count(*) < 3")
def skipped_sets(spark, d):
    return preference.enough_candidates(preference.unique_candidates(_candidates(spark, d), "id", "i", "content"), "id", 3)[1]


_VALID = f"""(SELECT id FROM {T.SCORES} GROUP BY id HAVING bool_and(coalesce({T.COMPLETE}, false)) AND count(*) >= 2)"""
_BEST = f"""(SELECT id, s FROM (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY s.accuracy DESC, s.closure DESC, s.auto_resolve DESC, s.satisfaction DESC, s.overall_score DESC,
  {T.ALIGNED} DESC, s."index") AS pos FROM {T.SCORES} JOIN {_VALID} USING (id) WHERE s.hallucination = 0) WHERE pos = 1)"""
_WORST = f"""(SELECT id, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s.closure, s.auto_resolve, s.satisfaction, s.overall_score, s."index") AS pos FROM (
  SELECT *, min(pool) OVER (PARTITION BY id) AS use FROM (SELECT x.id, x.s, CASE WHEN x.s.hallucination = 0 AND x.s.accuracy = 1 AND (x.s.closure = 0 OR x.s.auto_resolve = 0) THEN 0
  WHEN x.s.hallucination = 0 THEN 1 ELSE 2 END AS pool FROM {T.SCORES} x JOIN {_BEST} b ON b.id = x.id WHERE x.s."index" <> b.s."index")) WHERE pool = use) WHERE pos = 1)"""
_JUDGED = f"""(SELECT r.id, CASE WHEN v.id IS NULL THEN 'invalid_scores' WHEN b.id IS NULL THEN 'all_hallucinated' WHEN w.id IS NULL THEN 'no_rejected' ELSE 'ok' END AS status,
  b.s."index" AS best_index, w.s."index" AS worst_index, {T.ALIGNED.replace('s.', 'b.s.')} AS hi, {T.ALIGNED.replace('s.', 'w.s.')} AS lo
  FROM {T.RANKED} r LEFT JOIN {_VALID} v ON v.id = r.id LEFT JOIN {_BEST} b ON b.id = r.id LEFT JOIN {_WORST} w ON w.id = r.id)"""


@query(f"SELECT id, status, best_index, worst_index, round(hi * 100)::BIGINT AS best_cents, round((hi - lo) * 100)::BIGINT AS delta_cents FROM {_JUDGED}")
def judged_pairs(spark, d):
    j = preference.judged_pairs(T.ranked(spark, d))
    return j.select("id", "status", "best_index", "worst_index", F.round(F.col("best_score") * 100).cast("bigint").alias("best_cents"),
                    F.round((F.col("best_score") - F.col("worst_score")) * 100).cast("bigint").alias("delta_cents"))


@query(f"SELECT status, count(*) AS n FROM {_JUDGED} GROUP BY 1")
def judged_status(spark, d):
    return preference.judged_pairs(T.ranked(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


_TRIM = f"regexp_replace(coalesce(%s, ''), '^[{T._SP}]+|[{T._SP}]+$', '', 'g')"
_USABLE = f"""(SELECT *, CASE WHEN {_TRIM % 'chosen'} = {_TRIM % 'rejected'} THEN 'equal_texts' WHEN delta IS NULL OR isnan(delta) THEN 'no_delta' ELSE 'kept' END AS use FROM {T.PAIRS})"""
_WEAK = f"""(SELECT *, row_number() OVER (ORDER BY delta, id) AS pos, count(*) OVER () AS n FROM {_USABLE} WHERE use = 'kept')"""


def _usable(spark, d):
    return T.pairs(spark, d).withColumn("use", preference.usable_pair(F.col("chosen"), F.col("rejected"), F.col("delta")))


@query(f"SELECT id, delta, pos > round_even(n * 0.1, 0) AS kept FROM {_WEAK}")
def weak_pairs(spark, d):
    return preference.weakest_dropped(_usable(spark, d).filter("use = 'kept'").select("id", "delta"), "delta", "id", 0.1)


_NTH = {"lowest": 0.0, "p10": 0.1, "p30": 0.3, "median": 0.5, "p70": 0.7, "p90": 0.9, "highest": 1.0}


@query(f"""WITH t AS (SELECT list(delta ORDER BY delta) AS l FROM {_USABLE} WHERE use = 'kept') SELECT len(l) AS count,
  {', '.join(f"l[(floor((len(l) - 1) * {p}::DOUBLE + 1e-9) + 1)::INT] AS {n}" for n, p in _NTH.items())}, round(list_avg(l), 4) AS mean FROM t""")
def delta_stats(spark, d):
    return preference.nth_stats(_usable(spark, d).filter("use = 'kept'"), "delta", _NTH).withColumn("mean", F.round("mean", 4))


@query(f"""SELECT (SELECT count(*) FROM {T.PAIRS}) AS records, count(*) AS raw_pairs, count_if(pos > round_even(n * 0.1, 0)) AS kept_pairs, count_if(pos <= round_even(n * 0.1, 0)) AS dropped_pairs,
  (SELECT count(*) FROM {_USABLE} WHERE use <> 'kept') AS skipped_pairs, max(CASE WHEN pos <= round_even(n * 0.1, 0) THEN delta END) AS drop_threshold FROM {_WEAK}""")
def pair_summary(spark, d):
    u = cut(_usable(spark, d).select("id", "delta", "use"))
    w = preference.weakest_dropped(u.filter("use = 'kept'"), "delta", "id", 0.1)
    kept = w.agg(F.count("*").alias("raw_pairs"), F.count_if("kept").alias("kept_pairs"), F.count_if(~F.col("kept")).alias("dropped_pairs"), F.max(F.when(~F.col("kept"), F.col("delta"))).alias("drop_threshold"))
    return u.agg(F.count("*").alias("records"), F.count_if(F.col("use") != "kept").alias("skipped_pairs")).join(kept)  # one row each


#: Terms and patterns that a rewrite must not bring in.
RISKY_TERMS = ("已发货", "已出库", "待审核", "当前显示", "已揽收", "中转站", "派送中", "已签收", "今天", "明天", "今晚", "小时内", "后台", "审核", "自动", "系统同步", "系统已", "系统将",
               "系统会", "触发", "异常预警", "仓库", "打包", "出库", "发出", "优先", "通道", "直连", "拦截", "已为您", "已帮您", "帮您处理", "帮您备注", "帮您加急", "已处理", "已备注",
               "已加急", "已退款", "已补发", "运费", "费用", "免费", "赔付", "赔偿", "补偿", "补发", "返还", "退还", "垫付", "上门取件", "取件", "赠券", "优惠券", "维修")
RISKY_PATTERNS = ("(预计|最晚|大概|约).{0,8}(\\d+\\s*[-~到]\\s*\\d+\\s*(天|个工作日|小时)|\\d+\\s*(天|个工作日|小时)内)",
                  "(预计|最晚|大概|约).{0,12}(今天|明天|今晚|本周|下周|周[一二三四五六日天]|星期[一二三四五六日天])",
                  "\\d{1,2}[:：]\\d{2}", "\\d{1,2}\\s*点", "\\d{1,2}\\s*月\\s*\\d{1,2}\\s*日", "\\d{1,2}\\s*[-/]\\s*\\d{1,2}")

_NEW = f"regexp_replace(regexp_replace({_TRIM % 'chosen'}, '(?s)<think>.*?</think>', '', 'g'), '^[{T._SP}]+|[{T._SP}]+$', '', 'g')"
_GATE = f"""(SELECT id, CASE WHEN x = '' THEN 'empty' WHEN x = {_TRIM % 'rejected'} THEN 'unchanged' WHEN length(x) < 8 THEN 'too_short'
  WHEN {' OR '.join(f"(contains(x, '{t}') AND NOT contains(y, '{t}'))" for t in RISKY_TERMS)} THEN 'adds_terms'
  WHEN {' OR '.join(f"(regexp_matches(x, '{p}') AND NOT regexp_matches(y, '{p}'))" for p in RISKY_PATTERNS)} THEN 'adds_patterns' END AS reason
  FROM (SELECT *, {_NEW} AS x, coalesce(rejected, '') AS y FROM {T.PAIRS}))"""


@query(f"SELECT id, reason FROM {_GATE}")
def rewrite_gate(spark, d):
    """Each chosen answer as a rewrite of the rejected one."""
    return T.pairs(spark, d).select("id", rewrite.rewrite_reason(F.col("chosen"), F.col("rejected"), RISKY_TERMS, RISKY_PATTERNS).alias("reason"))


@query(f"SELECT id, CASE WHEN coalesce(reference, '') <> '' THEN reference ELSE rejected END AS answer, CASE WHEN coalesce(reference, '') <> '' THEN rejected END AS original FROM {T.PAIRS}")
def rewrite_overlay(spark, d):
    t = T.pairs(spark, d)
    out = rewrite.overlaid(t.select("id", "rejected"), t.select("id", "reference", "question_type"), "id", "rejected", "reference", ["question_type"])
    return out.select("id", F.col("rejected").alias("answer"), F.col("rewrite.original").alias("original"))


_RATIO = {"lowest": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "highest": 1.0}


@query(f"""WITH t AS (SELECT list(r ORDER BY r) AS l FROM (SELECT length(chosen)::DOUBLE / length(rejected) AS r FROM {T.PAIRS} WHERE length(rejected) > 0 AND chosen IS NOT NULL)) SELECT len(l) AS count,
  {', '.join(f"round(l[(round_even((len(l) - 1) * {p}::DOUBLE, 0) + 1)::INT], 4) AS {n}" for n, p in _RATIO.items())}, round(list_avg(l), 4) AS mean FROM t""")
def length_ratio_stats(spark, d):
    t = T.pairs(spark, d).withColumn("r", rewrite.length_ratio(F.length("rejected"), F.length("chosen")))
    s = preference.nth_stats(t, "r", _RATIO, half_even=True)
    return s.select("count", *[F.round(n, 4).alias(n) for n in (*_RATIO, "mean")])


_PAIR_SCORES = f"""(SELECT p.id, p.chosen, c.s AS c, r.s AS r FROM {T.PAIRS} p JOIN {T.SCORES} c ON c.id = p.id AND c.s."index" = p.chosen_index JOIN {T.SCORES} r ON r.id = p.id AND r.s."index" = p.rejected_index)"""


@query(f"""WITH q AS (SELECT id, list_filter([CASE WHEN c.accuracy <> 1 THEN 'chosen_not_accurate' END, CASE WHEN c.closure <> 1 THEN 'chosen_not_closed' END,
  CASE WHEN c.auto_resolve <> 1 THEN 'chosen_not_resolved' END, CASE WHEN c.satisfaction < 4 THEN 'chosen_low_satisfaction' END, CASE WHEN {_any("coalesce(chosen, '')", RISKY_TERMS)} THEN 'chosen_risky_content' END,
  CASE WHEN r.hallucination = 1 THEN 'rejected_hallucinated' END, CASE WHEN r.accuracy <> 1 THEN 'rejected_not_accurate' END,
  CASE WHEN NOT (r.closure = 0 OR r.auto_resolve = 0) THEN 'rejected_not_weak' END], lambda x: x IS NOT NULL) AS reasons FROM {_PAIR_SCORES})
  SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(reasons) > 0 THEN reasons ELSE ['kept'] END) AS reason FROM q) GROUP BY 1""")
def quality_reasons(spark, d):
    r = T.ranked(spark, d).select("id", "scores")
    t = T.pairs(spark, d).join(r, "id")
    t = t.select("id", F.coalesce("chosen", F.lit("")).alias("chosen"), F.explode(F.filter("scores", lambda x: x["index"] == F.col("chosen_index"))).alias("c"), "scores", "rejected_index")
    t = t.select("id", "chosen", "c", F.explode(F.filter("scores", lambda x: x["index"] == F.col("rejected_index"))).alias("r"))
    reasons = preference.quality_reasons(F.col("c"), F.col("r"), text.contains_any(F.col("chosen"), RISKY_TERMS))
    return (t.select(F.explode(F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("kept")))).alias("reason"))
            .groupBy("reason").agg(F.count("*").alias("n")))


@query(f"SELECT round(avg(hi - lo), 6) AS margin, round(avg((hi > lo)::INT), 6) AS accuracy FROM {_JUDGED} WHERE status = 'ok'")
def reward_margin(spark, d):
    j = preference.judged_pairs(T.ranked(spark, d)).filter("status = 'ok'")
    return preference.reward_margin(j, "best_score", "worst_score").select(F.round("margin", 6).alias("margin"), F.round("accuracy", 6).alias("accuracy"))


# --- judges, logs, experiments --------------------------------------------------------------------------------------

def _judgements(spark, d):
    s = T.ranked(spark, d).select("id", "rank_model", F.explode("scores").alias("s"))
    ok = preference.complete(F.col("s"))
    return s.filter(ok).select("rank_model", "s.accuracy", "s.auto_resolve", "s.closure", "s.satisfaction")


def _summary_sql(by: str) -> str:
    share = ", ".join(f"round(sum(s.{m}) / count(*), 6) AS {m}, round(sum(s.{m}) / count(*) * 100, 2) AS {m}_percent" for m in judge.METRICS)
    return f"SELECT {by + ', ' if by else ''}count(*) AS samples, {share}, round(sum(s.satisfaction) / count(*), 3) AS csat FROM {T.SCORES} WHERE {T.COMPLETE} {'GROUP BY 1' if by else ''}"


@query(_summary_sql(""))
def judge_summary(spark, d):
    return judge.judge_summary(_judgements(spark, d))


@query(_summary_sql("rank_model"))
def judge_summary_by_model(spark, d):
    return judge.judge_summary(_judgements(spark, d), ["rank_model"])


@query("SELECT date_trunc('day', ts) AS step, event_type AS metric, count(*) AS n, max(value) AS top FROM events WHERE value IS NOT NULL GROUP BY ALL")
def metric_series(spark, d):
    t = T.read(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("step")).pivot("event_type").agg(F.struct(F.count("value").alias("n"), F.max("value").alias("top")))
    kinds = [c for c in t.columns if c != "step"]
    rows = t.select("step", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("v")) for k in kinds])).alias("p"))
    return rows.select("step", "p.metric", "p.v.n", "p.v.top").filter("n > 0")


@query("""SELECT event_type AS run, arg_min(day, (total, day)) AS best_step, min(total) AS best_value FROM (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS total FROM events GROUP BY ALL) GROUP BY 1""")
def best_checkpoint(spark, d):
    t = T.read(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("total"))
    return judge.best_step(t, "run", "day", "total")


@query(f"""SELECT m.rank_model, t.sets, j.samples, coalesce(t.sets, 0) + 0.5 AS beta FROM (SELECT DISTINCT rank_model FROM ranked UNION SELECT 'judge-unused') m
  LEFT JOIN (SELECT rank_model, count(*) AS sets FROM {T.RANKED} GROUP BY 1) t ON t.rank_model = m.rank_model
  LEFT JOIN (SELECT rank_model, count(*) AS samples FROM {T.SCORES} WHERE {T.COMPLETE} GROUP BY 1) j ON j.rank_model = m.rank_model""")
def experiment_summary(spark, d):
    r = T.ranked(spark, d)
    runs = r.select("rank_model").distinct().unionByName(spark.createDataFrame([("judge-unused",)], "rank_model string"))
    training = r.groupBy("rank_model").agg(F.count("*").alias("sets")).withColumn("beta", F.col("sets") + F.lit(0.5))
    judged = judge.judge_summary(_judgements(spark, d), ["rank_model"]).select("rank_model", "samples")
    return judge.experiment_summary(runs, training, judged, "rank_model", F.lit(0.5)).select("rank_model", "sets", "samples", F.col("beta").cast("double").alias("beta"))


@query("SELECT name, r AS rank, b AS beta, name || '_r' || r || '_b' || replace(b::VARCHAR, '.', 'p') AS tag FROM (SELECT 'base' AS name), (SELECT unnest([8, 16, 32]) AS r), (SELECT unnest([0.05, 0.1, 0.3]::DOUBLE[]) AS b)")
def config_grid(spark, d):
    g = judge.config_grid(spark.createDataFrame([("base",)], "name string"), {"rank": [8, 16, 32], "beta": [0.05, 0.1, 0.3]})
    return g.withColumn("tag", F.concat("name", F.lit("_r"), "rank", F.lit("_b"), text.run_tag(F.col("beta"))))


_TERMS = ("运费", "优惠码", "取消", "质检员", "终身保修", "保修")


@query(f"SELECT t AS term, coalesce(n, 0) AS n FROM (SELECT unnest([{_list(_TERMS)}]) AS t) LEFT JOIN (SELECT u AS t, count(*) AS n FROM (SELECT unnest([{_list(_TERMS)}]) AS u, answer FROM {T.QA}) WHERE contains(answer, u) GROUP BY 1) USING (t)")
def term_counts(spark, d):
    return judge.term_counts(T.qa(spark, d), "answer", list(_TERMS))


@query("""SELECT coalesce(source, '?') AS source, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99, max(n_chars) AS longest
  FROM documents WHERE n_chars IS NOT NULL GROUP BY 1""")
def length_percentiles(spark, d):
    t = T.read(spark, d, "documents").filter("n_chars is not null").select(F.coalesce("source", F.lit("?")).alias("source"), "n_chars")
    return t.groupBy("source").agg(*[F.round(F.percentile("n_chars", p), 6).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))], F.max("n_chars").alias("longest"))


@query("SELECT sum(p_size)::BIGINT AS total, sum(CASE WHEN p_size > 25 THEN p_size ELSE 0 END)::BIGINT AS trainable, sum(CASE WHEN p_size > 25 THEN 0 ELSE p_size END)::BIGINT AS frozen, round(sum(CASE WHEN p_size > 25 THEN p_size ELSE 0 END) / sum(p_size) * 100, 6) AS percent FROM part")
def parameter_summary(spark, d):
    return judge.parameter_summary(T.read(spark, d, "part").withColumn("on", F.col("p_size") > 25), "p_size", "on")


@query("""SELECT '| region | nations |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |', chr(10) ORDER BY r_regionkey) AS markdown FROM (
  SELECT r_regionkey, r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)""")
def markdown_report(spark, d):
    t = T.read(spark, d, "nation").join(T.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = t.groupBy("r_regionkey", F.col("r_name").alias("region")).agg(F.count("*").alias("nations"))
    return judge.markdown_table(t, ["region", "nations"], [F.col("r_regionkey")])


# --- increments, caches, model calls, JSON --------------------------------------------------------------------------

@query(f"SELECT r.id FROM {T.RANKED} r WHERE r.id NOT IN (SELECT id FROM dpo_pairs WHERE id IS NOT NULL)")
def pending_sets(spark, d):
    return external.pending(T.ranked(spark, d), T.read(spark, d, "dpo_pairs"), "id").select("id")


@query("SELECT id, max(loaded_at) AS loaded_at FROM sft_train GROUP BY 1")
def latest_records(spark, d):
    return external.latest(T.read(spark, d, "sft_train").select("id", "source", "loaded_at"), "id", "loaded_at").select("id", "loaded_at")


@query()
def offline_answers(spark, d):
    """A deterministic stand-in answers every question that has one."""
    t = T.pairs(spark, d).filter("question is not null").select("id", "question")
    return external.ask(t, "id", "question", lambda: external.EchoModel(["可以的。", "请稍等，马上为您核实。"])).select("id", "ok", "response")


@query("SELECT event_id, CASE WHEN json_valid(props) THEN json_type(props) END AS kind FROM events")
def json_kinds(spark, d):
    v = F.schema_of_variant(text.lenient_json(F.col("props")))
    return T.read(spark, d, "events").select("event_id", F.when(v.startswith("OBJECT"), "OBJECT").when(v.startswith("ARRAY"), "ARRAY").otherwise(v).alias("kind"))


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS lowest, max(value) AS highest FROM events GROUP BY 1, 2""")
def windowed_events(spark, d):
    w = increments.windowed_metrics(T.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 hour", "1 day")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "lowest", "highest")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 hours
  THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def user_sessions(spark, d):
    s = increments.sessions(T.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "2 hours", "1 day")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


# --- record shapes, prompts, remaining joins ------------------------------------------------------------------------

@query(f"""SELECT 'customer_service_' || lpad(idx::VARCHAR, 6, '0') AS id, idx, question AS first, answer AS second FROM {T.QA}""")
def qa_records(spark, d):
    t = T.qa(spark, d)
    r = t.select("idx", *records.qa_record(F.col("idx"), F.col("question"), F.col("answer")))
    return r.select("id", "idx", F.col("conversations")[0]["value"].alias("first"), F.col("conversations")[1]["value"].alias("second"))


@query(f"""SELECT id, '问：' || coalesce(question, '') || chr(10) || '答：' || coalesce(chosen, '') || chr(10) || '不超过' || least(220, greatest(length(coalesce(chosen, '')) + 80, length(coalesce(chosen, '')) * 22 // 10)) || '字' AS prompt
  FROM {T.PAIRS}""")
def rewrite_prompts(spark, d):
    n = text.target_length(F.coalesce("chosen", F.lit("")))
    return T.pairs(spark, d).select("id", text.filled("问：{q}\n答：{a}\n不超过{n}字", q=F.col("question"), a=F.col("chosen"), n=n).alias("prompt"))


@query(f"""SELECT id, string_agg('[candidate ' || i || '] temperature=' || (ARRAY[0.5, 0.7, 0.9])[i + 1] || ', top_p=0.9' || chr(10) || content, chr(10) || chr(10) ORDER BY i) AS lines FROM {_UNIQUE} GROUP BY 1""")
def candidate_lines(spark, d):
    grid = preference.sampling_grid([0.5, 0.7, 0.9], [0.9, 0.9, 0.9])
    u = preference.unique_candidates(_candidates(spark, d), "id", "i", "content")
    warm = F.element_at(F.array(*[F.lit(t) for _, t, _ in grid]), F.col("i") + 1)
    rows = u.select("id", F.struct(F.col("i").alias("index"), warm.alias("temperature"), F.lit(0.9).alias("top_p"), "content").alias("c"))
    return rows.groupBy("id").agg(text.candidates_text(F.array_sort(F.collect_list("c"))).alias("lines"))  # a few candidates each


@query(f"""SELECT p.id, list_filter([p.chosen_index, p.rejected_index, 9], lambda x: NOT list_contains(list_transform(r.scores, lambda s: s."index"), x)) AS missing FROM {T.PAIRS} p JOIN {T.RANKED} r ON r.id = p.id
  WHERE r.scores IS NOT NULL AND p.chosen_index <> p.rejected_index""")
def missing_scores(spark, d):
    t = T.pairs(spark, d).join(T.ranked(spark, d).select("id", "scores"), "id").filter("scores is not null and chosen_index != rejected_index")
    wanted = F.array("chosen_index", "rejected_index", F.lit(9))
    return t.select("id", preference.missing_scores(wanted, F.col("scores")).alias("missing"))


_GENERIC = _list(_PACK.generic_topics)


@query(f"""WITH k AS (SELECT *, {_TOPICS} AS t FROM {T.CLUSTERED}), f AS (SELECT cluster_id, arg_min(t, id) AS first FROM k GROUP BY 1)
  SELECT id, list_has_any(t, first) OR (len(list_filter(t, lambda x: x NOT IN ({_GENERIC}))) = 0 AND len(list_filter(first, lambda x: x NOT IN ({_GENERIC}))) = 0) AS compatible FROM k JOIN f USING (cluster_id)""")
def topic_compatibility(spark, d):
    """Whether each question fits the first one of its cluster."""
    t = T.clustered(spark, d).withColumn("t", rules.question_topics(F.col("question"))).select("cluster_id", "id", "t")
    first = t.groupBy("cluster_id").agg(F.min_by("t", "id").alias("first"))
    return t.join(first, "cluster_id").select("id", rules.topics_compatible(F.col("t"), F.col("first")).alias("compatible"))


@query("""SELECT step, click, purchase FROM (SELECT ts AS step, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events GROUP BY 1)
  WHERE click IS NOT NULL OR purchase IS NOT NULL""")
def wide_metrics(spark, d):
    e = T.read(spark, d, "events").groupBy(F.col("ts").alias("step")).agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "purchase")])
    log = e.select("step", F.create_map(F.lit("click"), "click", F.lit("purchase"), "purchase").alias("v"))
    return judge.wide_log(log, "step", "v", ["click", "purchase"])


@query(f"""SELECT p.id, p.chosen AS answer, coalesce(r.scores IS NOT NULL, false) AS ranked FROM {T.PAIRS} p LEFT JOIN {T.RANKED} r ON r.id = p.id""")
def pairs_with_rankings(spark, d):
    t = T.pairs(spark, d).join(T.ranked(spark, d).select("id", F.col("scores").isNotNull().alias("r")), "id", "left")
    return t.select("id", F.col("chosen").alias("answer"), F.coalesce("r", F.lit(False)).alias("ranked"))


@query(f"""SELECT id, turns, multi FROM (SELECT c.id, len(v.conversations) // 2 AS turns, v.conversations IS NOT NULL AS multi FROM {T.CONVERSATIONS} c
  LEFT JOIN (SELECT replace(id, 'csv_', 'cst_') AS id, any_value(conversations) AS conversations FROM sft_val WHERE conversations IS NOT NULL GROUP BY 1) v ON v.id = c.id)""")
def dialogue_overlay(spark, d):
    """Held-out dialogues laid over the training records of the same number."""
    base = T.read(spark, d, "sft_train").select("id", "conversations").dropDuplicates(["id"])
    v = T.read(spark, d, "sft_val").filter("conversations is not null").select(F.replace("id", F.lit("csv_"), F.lit("cst_")).alias("id"), records.to_messages(F.col("conversations")).alias("m")).dropDuplicates(["id"])
    out = records.with_dialogue(base, v, "id", "m")
    return out.select("id", F.col("augmentation_turns").cast("bigint").alias("turns"), F.col("augmented_multi_turn").alias("multi"))


@query()
def answer_hour_windows(spark, d):
    """Per question type the window that its answers' time spans suggest, in whole hours."""
    t = T.qa(spark, d).withColumn("kind", rules.question_type(rules.question_topics(F.col("question"))))
    spans = t.select("kind", F.explode(rules.time_ranges(F.col("answer"))).alias("r")).select("kind", "r.lo", "r.hi")
    low = F.percentile(F.when(F.col("lo") > 0, F.col("lo")), 0.15)
    high = F.percentile(F.when(F.col("hi") > 0, F.col("hi")), 0.85)
    w = spans.groupBy("kind").agg(F.count("*").alias("spans"), low.alias("lo"), high.alias("hi"))
    return w.select("kind", "spans", families.rounded_hours(F.col("lo"), False).alias("from_hours"), families.rounded_hours(F.col("hi"), True).alias("to_hours"))


@query()
def hashed_vectors(spark, d):
    """Offline sentence vectors of the distinct questions."""
    t = T.qa(spark, d).groupBy("question").agg(F.min("idx").alias("idx"))
    return external.embed(t, "idx", "question", external.HashEncoder).select("idx", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))
