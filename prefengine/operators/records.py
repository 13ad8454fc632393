"""Shapes of conversation records: turns to messages, prompts and references, dialogues and their overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.functions.text import clean_text, contains_any, dedup_key


def to_messages(turns: Column) -> Column:
    """{from, value} turns as {role, content} messages with the usual role names."""
    role = lambda x: F.when(x["from"].isin("human", "user"), "user").when(x["from"].isin("gpt", "assistant"), "assistant").otherwise(x["from"])
    return F.transform(turns, lambda x: F.struct(role(x).alias("role"), x["value"].alias("content")))


def with_system(messages: Column, prompt: str) -> Column:
    """A system message in front, unless one is there or the prompt is empty."""
    if not prompt:
        return messages
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    first = F.try_element_at(messages, F.lit(1))["role"]
    return F.when(first.eqNullSafe("system"), messages).otherwise(F.concat(system, messages))


def ends_with(messages: Column, role: str = "assistant") -> Column:
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == role, F.lit(False))


def prompt_of(messages: Column) -> Column:
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))


def reference_of(messages: Column) -> Column:
    return F.try_element_at(messages, F.lit(-1))["content"]


def first_turn(messages: Column, role: str, default: str = "") -> Column:
    """The first content of a role."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"], F.lit(default))


def qa_record(idx: Column, question: Column, answer: Column, prefix: str = "customer_service") -> list[Column]:
    """(id, conversations) of a question and an answer."""
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return [F.format_string(f"{prefix}_%06d", idx).alias("id"), F.array(turn("user", question), turn("assistant", answer)).alias("conversations")]


def dialogue_reason(messages: Column, forbidden: tuple[str, ...] = ()) -> Column:
    """Why a dialogue is refused, or null: 4 to 8 messages, an even number, roles in turn, contents, no forbidden term."""
    n = F.size(messages)
    turn = F.transform(messages, lambda m, i: m["role"].eqNullSafe(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))))
    text = F.transform(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))))
    return (F.when(messages.isNull(), "no_messages").when(~n.between(4, 8) | (n % 2 != 0), "wrong_number")
            .when(~F.forall(turn, lambda x: x), "wrong_role").when(F.exists(text, lambda t: t == ""), "empty_content")
            .when(F.exists(text, lambda t: contains_any(t, forbidden)), "forbidden_term"))


def with_dialogue(rows: DataFrame, dialogues: DataFrame, record: str, messages: str) -> DataFrame:
    """rows whose conversation is replaced by a dialogue where there is one, with two fields that say so."""
    d = dialogues.select(F.col(record), F.col(messages).alias("_d"))
    turns = F.transform("_d", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value")))
    return (rows.join(d, record, "left")
            .withColumn("augmented_multi_turn", F.col("_d").isNotNull())
            .withColumn("augmentation_turns", F.when(F.col("_d").isNotNull(), F.floor(F.size("_d") / 2).cast("int")))
            .withColumn("conversations", F.coalesce(turns, F.col("conversations"))).drop("_d"))


def pair_record(record: str, prompt: Column, chosen: Column, rejected: Column, reference: Column, metadata: list[Column]) -> list[Column]:
    """The columns of a preference record."""
    message = lambda c: F.array(F.struct(F.lit("assistant").alias("role"), c.alias("content")))
    return [F.col(record), prompt.alias("prompt"), message(chosen).alias("chosen"), message(rejected).alias("rejected"),
            reference.alias("reference"), F.struct(*metadata).alias("metadata")]


def by_index(items: Column, index: Column) -> Column:
    """The element whose index field is the given one, or null."""
    return F.try_element_at(F.filter(items, lambda x: x["index"] == index), F.lit(1))


def cleaned_pairs(rows: DataFrame, place: str, conversations: str = "conversations", record: str = "id", prefix: str = "sample") -> DataFrame:
    """(place, source_id, question, answer, question_norm, answer_norm) of the first two turns, cleaned again.

    A row without an id is named by its place; rows of fewer than two turns are left out.
    """
    turn = lambda i: clean_text(F.try_element_at(F.col(conversations), F.lit(i))["value"])
    out = rows.filter(F.size(conversations) >= 2).select(
        F.col(place).alias("place"), F.coalesce(F.col(record), F.format_string(f"{prefix}_%06d", F.col(place))).alias("source_id"), turn(1).alias("question"), turn(2).alias("answer"))
    return out.withColumns({"question_norm": dedup_key(F.col("question")), "answer_norm": dedup_key(F.col("answer"))})


def pair_cache(ranked: DataFrame, judged: DataFrame, record: str = "id", prompt: str = "prompt", candidates: str = "candidates", scores: str = "scores") -> DataFrame:
    """(record, prompt, chosen, rejected, ranking_brief) of the judged sets whose best and worst candidate and scores are there.

    ``candidates`` and ``scores`` are arrays with an index field; sets without a pair, or with an index that names nothing,
    are left out.
    """
    own = ranked.select(F.col(record), F.col(prompt).alias("prompt"), F.col(candidates).alias("_c"), F.col(scores).alias("_s")).join(judged, record)
    pick = lambda c, at: by_index(F.col(c), F.col(at))
    out = own.select(F.col(record), "prompt", pick("_c", "best_index")["content"].alias("chosen"), pick("_c", "worst_index")["content"].alias("rejected"),
                     F.struct("score_delta", "best_score", "worst_score", "best_index", "worst_index", pick("_s", "best_index").alias("chosen_scores"),
                              pick("_s", "worst_index").alias("rejected_scores")).alias("ranking_brief"))
    return out.filter(F.col("chosen").isNotNull() & F.col("rejected").isNotNull() & F.col("ranking_brief.chosen_scores").isNotNull() & F.col("ranking_brief.rejected_scores").isNotNull())
