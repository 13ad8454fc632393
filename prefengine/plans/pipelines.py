"""The operators put together: raw rows to training records, records to clusters and their answers, scores to pairs.

Each pipeline returns its tables by name, audits and report included; nothing is written here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.config import CleanConfig, ClusterConfig, PreferenceConfig
from prefengine.functions import rules, text
from prefengine.operators import dedup, families, graph, preference, records, sampling
from prefengine.plans.lineage import cut
from prefengine.schemas import require


def _audit(df: DataFrame, stage: str, record: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (record, "reason")]
    return df.select(F.lit(stage).alias("stage"), "reason", F.col(record).cast("string").alias("record"), F.to_json(F.struct(*rest)).alias("payload"))


def clean_rows(raw: DataFrame, config: CleanConfig = CleanConfig()) -> dict[str, DataFrame]:
    """row_idx, question_raw, answer_raw -> all, train, val, audit, funnel."""
    require(raw, "row_idx", "question_raw", "answer_raw")
    rows = raw.select(F.col("row_idx").alias("idx"), text.clean_text(F.col("question_raw")).alias("question"), text.clean_text(F.col("answer_raw")).alias("answer"))
    rows = cut(rows.withColumns({"q": text.squeezed(F.col("question")), "a": text.squeezed(F.col("answer")),
                                 "reason": dedup.drop_reason(F.col("question"), F.col("answer"), config.min_question_chars, config.min_answer_chars)}))
    kept = rows.filter("reason is null").drop("reason")
    best = [F.length("answer"), F.length("question"), -F.col("idx")]
    exact = cut(dedup.keep_best(kept, ["q", "a"], best, "idx"))
    unique = exact.filter("duplicate_of is null").drop("duplicate_of").withColumns({"r1": best[0], "r2": best[1], "r3": best[2]})
    decided = cut(dedup.fuzzy_dedup(unique, "idx", "q", "a", ["r1", "r2", "r3"], config.question_threshold, config.answer_threshold, config.pair_threshold))
    final = unique.join(decided.filter("kept").select("idx"), "idx")
    out = sampling.split(final.select("idx", *records.qa_record(F.col("idx"), F.col("question"), F.col("answer"))), "idx", config.val_ratio, config.seed)
    audit = (_audit(rows.filter("reason is not null").select("idx", "reason", "question", "answer"), "clean", "idx")
             .unionByName(_audit(exact.filter("duplicate_of is not null").select("idx", F.lit("exact_duplicate").alias("reason"), "duplicate_of", "question", "answer"), "exact", "idx"))
             .unionByName(_audit(decided.filter("not kept").select("idx", F.lit("fuzzy_duplicate").alias("reason")).join(unique.select("idx", "question", "answer"), "idx"), "fuzzy", "idx")))
    return {"all": out.drop("split"), "train": out.filter("split = 'train'").drop("split"), "val": out.filter("split = 'val'").drop("split"),
            "audit": dedup.audit_sample(audit, "reason", "record", config.audit_limit),
            "funnel": dedup.funnel({"raw": raw, "after_clean": kept, "after_exact": unique, "after_fuzzy": final})}


def cluster_rows(rows: DataFrame, config: ClusterConfig = ClusterConfig(), pack: rules.RulePack = rules.ZH_SHOP) -> dict[str, DataFrame]:
    """idx, question, answer (and vector, for the dense backend) -> clusters, families, contradictions, cut_off, records, train, val.

    Questions are linked by similarity (where their topics are compatible), by equal keys and by semantic keys.
    """
    require(rows, "idx", "question", "answer", *(["vector"] if config.backend == "dense" else []))
    base = rows.withColumns({"q": text.squeezed(F.col("question")), "a": text.squeezed(F.col("answer")), "topics": rules.question_topics(F.col("question"), pack)})
    base = cut(base.withColumn("kind", rules.question_type(F.col("topics"), pack)))
    if config.backend == "dense":
        edges = graph.knn_graph(base, "idx", "vector", config.threshold(), config.neighbours - 1).select("src", "dst")
    else:
        one = base.groupBy("q").agg(F.min("idx").alias("idx"))  # equal questions are linked by their key anyway
        grams = cut(graph.char_tfidf(one, "idx", "q"))
        near = graph.sparse_matches(grams.withColumnRenamed("idx", "src"), grams.withColumnRenamed("idx", "dst"), "src", "dst", config.threshold(), config.neighbours)
        edges = near.filter("src != dst").select("src", "dst")
    topics = base.select("idx", "topics")
    edges = (edges.join(topics.withColumnsRenamed({"idx": "src", "topics": "ts"}), "src").join(topics.withColumnsRenamed({"idx": "dst", "topics": "td"}), "dst")
             .filter(rules.topics_compatible(F.col("ts"), F.col("td"), pack)).select("src", "dst"))
    for key in (F.col("q"), rules.semantic_key(F.col("question"), pack)):
        edges = edges.unionByName(graph.key_edges(base, "idx", key))
    parts = cut(graph.connected_components(base, edges, "idx"))
    clusters = cut(parts.join(graph.number_clusters(parts), "component").select(F.col("node").alias("idx"), "cluster_id", "size"))
    kinds = base.join(clusters, "idx")
    canonical = cut(families.canonical_questions(kinds, "cluster_id", "idx", "question", "q"))
    by_cluster = canonical.select("cluster_id", rules.question_type(rules.question_topics(F.col("question"), pack), pack).alias("cluster_kind"))
    scored = cut(families.scored_answers(kinds.join(by_cluster, "cluster_id").drop("topics", "kind").drop(*[c for c in ("vector",) if c in kinds.columns]), "answer", "cluster_kind", pack))
    merge, apart = families.split_paths(scored, "cluster_id", "cluster_kind", ["ship_time", "delivery_time", "international_delivery_time", "pickup", "damaged_goods"], config.large_cluster)
    merged = cut(families.merged_families(merge, "cluster_id", "idx", "answer", "a", config.family_threshold))
    single = families.singleton_families(apart, "cluster_id", "idx")
    table = families.family_table(merged, "cluster_id", "idx", "answer").unionByName(families.family_table(single, "cluster_id", "idx", "answer", bonus=False))
    table = table.filter(F.col("support") >= config.min_support).join(by_cluster, "cluster_id")
    judged = cut(families.contradictions(families.ranked_families(table, "cluster_id"), "cluster_id", "cluster_kind",
                                         ["ship_time", "delivery_time", "time_generic"], list(pack.stance_types), pack))
    kept, cut_off = families.top_families(judged, "cluster_id", config.max_answers)
    variants = families.question_variants(merged.unionByName(single, allowMissingColumns=True), "cluster_id", "idx", "question", "q", canonical, config.max_variants)
    out = cut(families.records_of(variants, kept.select("cluster_id", "family", "support", "score", "stance", "rep_answer"), "cluster_id", "question"))
    halves = sampling.split(out, "id", config.val_ratio, config.seed)
    return {"clusters": clusters, "canonical": canonical, "families": judged, "contradictions": judged.filter("contradiction is not null"), "cut_off": cut_off,
            "records": out, "train": halves.filter("split = 'train'").drop("split"), "val": halves.filter("split = 'val'").drop("split")}


def preference_pairs(candidates: DataFrame, ranked: DataFrame, config: PreferenceConfig = PreferenceConfig()) -> dict[str, DataFrame]:
    """candidates (id, index, content) and ranked (id, scores) -> kept, dropped, skipped, failed, summary, train, val."""
    require(candidates, "id", "index", "content")
    require(ranked, "id", "scores")
    preference.sampling_grid(list(config.temperatures), list(config.top_ps))
    unique = cut(preference.unique_candidates(candidates, "id", "index", "content"))
    enough, skipped = preference.enough_candidates(unique, "id", config.min_candidates)
    judged = cut(preference.judged_pairs(ranked.join(enough.select("id"), "id")))
    ok = judged.filter("status = 'ok'")
    for side, index in (("chosen", "best_index"), ("rejected", "worst_index")):
        ok = ok.join(unique.select("id", F.col("index").alias(index), F.col("content").alias(side)), ["id", index])
    ok = cut(ok.withColumn("use", preference.usable_pair(F.col("chosen"), F.col("rejected"), F.col("score_delta"))))
    pairs = cut(preference.weakest_dropped(ok.filter("use = 'kept'").drop("use", "status"), "score_delta", "id", config.discard_fraction))
    kept = pairs.filter("kept").drop("kept")
    halves = sampling.split(kept, "id", config.val_ratio, config.seed, rounding="ceil")
    return {"kept": kept, "dropped": pairs.filter("not kept").drop("kept"), "skipped": skipped, "failed": judged.filter("status != 'ok'").select("id", "status"),
            "summary": preference.nth_stats(pairs, "score_delta", {"lowest": 0.0, "p10": 0.1, "p30": 0.3, "median": 0.5, "p70": 0.7, "p90": 0.9, "highest": 1.0}),
            "train": halves.filter("split = 'train'").drop("split"), "val": halves.filter("split = 'val'").drop("split")}
