import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefengine.llm import lookalike, subjects, tokenize
from tests.conftest import DATA
from tests.oracle import connect, same


def test_look_alikes(rows):
    data = [(1, "Kösta 好。", "a 1"), (2, "Ｋöｓｔａ　好｡", "a 1"), (3, "Κösta 好。", " a​ 1 "), (4, "kösta 好。", "a 1"), (5, "Kösta 好。", "a ①"), (6, "Kösta 好。", "a1"),
            (7, None, "a 1"), (8, "Kösta 好。", "a 1"), (8, "Kösta 好。", "a 1"), (9, "Kösta 好。", "a ¹"), (10, "", "​"), (11, "﻿", "")]
    df = rows([(*r, "x") for r in data], "idx bigint, q string, a string, r string")
    got = sorted(map(tuple, lookalike.look_alikes(df, "idx", ["q", "a"]).collect()))
    assert got == [(1, 2), (1, 3), (2, 3), (2, 8), (3, 8), (10, 11)]
    one = {r["idx"]: (r["q"], r["a"]) for r in lookalike.one_form(df, ["q", "a"]).collect()}
    assert one[1] == one[2] == one[3] and one[7][0] is None and one[4] != one[1]
    assert lookalike.look_alikes(df.limit(0), "idx", ["q", "a"]).count() == 0
    clash = df.select(F.col("idx").alias("_seen"), F.col("q").alias("r"), F.col("a").alias("_raw"), F.lit(1).alias("lo"))
    assert sorted(map(tuple, lookalike.look_alikes(clash, "_seen", ["r", "_raw"]).collect())) == got


def normal(text, trie):
    return lookalike.one_spelling(pa.array([text], pa.string()), trie).to_pylist()[0]


def test_the_automaton_picks_the_spelling(rows):
    """Emptying the trie changes what comes out: the table alone has another spelling."""
    trie, empty = lookalike.SpellingTrie(["（黑）款", "Kösta", "好的"]), lookalike.SpellingTrie([])
    assert normal("(黑)款 Κösta", trie) == "（黑）款 Kösta" and normal("(黑)款 Κösta", empty) == "(黑)款 Kösta"
    assert normal("Kosta", trie) == "Kosta" and normal("x" * 100_000, trie) == "x" * 100_000 and normal(None, trie) is None
    df = rows([(i, "（黑）款 a", "b") for i in range(5)] + [(9, "(黑)款 a", "b")], "idx bigint, q string, a string")
    assert {r["q"] for r in lookalike.one_form(df, ["q"]).collect()} == {"（黑）款 a"}
    assert {r["q"] for r in lookalike.one_form(df, ["q"], most=0).collect()} == {"(黑)款 a"}


def test_the_vocabulary_does_not_decide_equality():
    some = ["Kösta", "Κösta", "Kosta", "Ｋöｓｔａ", "K\u200bösta", "好的", "好\ufe0f的", "(a)", "（a）", "（а）", "é\u0323", "ẹ\u0301", "e\u0301\u0323", "①", "1", "́x", "⼤⽉", "大月", "ﾊﾟ", "パ"]
    plain = lookalike.SpellingTrie([])
    for words in (["Kösta", "（a）"], ["Ｋöｓｔａ", "Kosta", "大月"], ["é\u0323", "パ"], some):
        trie = lookalike.SpellingTrie(words)
        for x in some:
            for y in some:
                assert (normal(x, trie) == normal(y, trie)) == (normal(x, plain) == normal(y, plain)), (words, x, y)


def test_costs_of_the_automaton():
    trie = lookalike.SpellingTrie(["kösta", "kosta", "costa"])
    assert trie.match("kоsta") == "kosta" and trie.match("kasta") is None and trie.match("kasta", 1.0) == "kosta"
    assert trie.match("kost", 1.0) == "kosta" and trie.match("xcosta", 1.0) == "costa" and trie.match("xcost", 1.0) is None and trie.match("xcost", 2.0) == "costa"
    assert trie.match("k\u200bo\u0308sta") == "kösta" and trie.match("ko\u0308st", 1.0) == "kösta" and lookalike.SpellingTrie([]).match("a", 1.0) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aＡАö①¹⼤大\u200b \u3000，,。｡\u0301", max_size=12))
def test_one_form_is_stable(t):
    once = normal(t, lookalike.SpellingTrie([]))
    assert normal(once, lookalike.SpellingTrie([])) == once


@pytest.fixture(scope="module")
def coder():
    return tokenize.encoder(tokenize.default_vocabulary())


@pytest.fixture(scope="module")
def reference(coder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
                             mergeable_ranks={t: i for i, t in enumerate(coder.tokens)}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_a_merge_queue(coder, reference, text):
    ids = coder.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text) and coder.decode(ids) == text


def test_ids_of_repeats_and_long_runs(coder, reference):
    rng = random.Random(1)
    for t in ("a" * 5000, "中" * 2000, "<|endoftext|>", "   \n\t ", "".join(rng.choice("ab ") for _ in range(3000)), "́😀" * 300):
        assert coder.encode(t).tolist() == reference.encode_ordinary(t) and coder.decode(coder.encode(t)) == t


def test_encode_corpus_round_trip(rows, coder):
    data = [(1, "你好 hello", 0), (2, None, 0), (3, "", 0), (4, "  \n", 0), (5, "你好 hello", 0)]
    df = rows(data, "doc_id bigint, text string, ids int")
    out = tokenize.encode_corpus(df)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got[2] == got[3] == [] and got[4] and got[1] == got[5] == coder.encode("你好 hello").tolist() and len(got) == 5
    back = {r["doc_id"]: r["text"] for r in tokenize.decode_corpus(out).collect()}
    assert back == {1: "你好 hello", 2: "", 3: "", 4: "  \n", 5: "你好 hello"}
    assert tokenize.encode_corpus(df.limit(0)).count() == 0


def labelled(seed, n):
    rng = random.Random(seed)
    words = {"food": ["冷冻水饺", "配料表", "保质期"], "law": ["惩罚性赔付", "消费者权益", "投诉材料"], "sport": ["登山杖", "背负系统", "跑鞋鞋底"]}
    fill = ["先说结论。", "感谢您的耐心等待。", "大家可以补充。", "This page was updated."]
    out = []
    for _ in range(n):
        own = rng.sample(sorted(words), rng.choice([0, 1, 1, 2]))
        s = [f"关于{rng.choice(words[x])}，说明写在第{rng.randint(1, 99)}节。" for x in own for _ in range(rng.randint(4, 9))] + rng.choices(fill, k=4)
        if own and len(s) > 11:
            s.append(f"顺带一提，{rng.choice(words[rng.choice(sorted(set(words) - set(own)))])}的事改天再说。")
        rng.shuffle(s)
        out.append(("".join(s), rng.choice(["a", None]), set(own)))
    return out


def test_held_out_accuracy():
    model = subjects.train(labelled(1, 400))
    evidence = subjects.Evidence(model.weights, 3)
    hit = total = 0
    for text, _, own in labelled(2, 200):
        c, n = evidence.counts(text)
        got = {model.subjects[s] for s in model.decode(subjects.features(c, n) @ model.shared, 0)}
        hit, total = hit + (got == own), total + 1
    assert hit >= 0.97 * total


def test_a_subject_without_labels_is_told_by_its_title():
    titles = {"food": "食品", "law": "法律", "sport": "运动", "mail": "集邮与邮票", "tea": "茶具"}
    model = subjects.train(labelled(5, 300), titles=titles)
    assert model.subjects == ["food", "law", "mail", "sport", "tea"]
    evidence = subjects.Evidence(model.weights, 5)

    def told(text):
        c, n = evidence.counts(text)
        return {model.subjects[s] for s in model.decode(subjects.features(c, n) @ model.shared, 0)}
    assert told("这套邮票很少见。集邮的人都知道。邮票要防潮。说明写在第3节。") == {"mail"} and told("关于登山杖，说明写在第3节。" * 6) == {"sport"} and told("先说结论。") == set()
    assert subjects.train(labelled(5, 300), titles={"food": "x"}).subjects == ["food"] and subjects.title_terms("物流与配送") == ["物流", "配送"]


def test_sentences():
    t = subjects.plain("<p>好的。价格3.50元！</p>\n1. See A1. Next one")
    ends = subjects.sentence_ends(t)
    assert [t[a:b].strip() for a, b in zip([0, *ends], ends)] == ["好的。", "价格3.50元！", "1. see a1.", "next one"]
    assert subjects.sentence_ends("。。 12 \n") == []


def test_words_stand_alone():
    e = subjects.Evidence({"close": (0, 1.0), "冷冻": (1, 1.0)}, 2)
    assert e.counts("The desk closes. Close it. 冷冻的。")[0].tolist() == [1.0, 1.0]


def test_subject_table(rows):
    model = subjects.train(labelled(3, 300))
    text = "关于登山杖，说明写在第3节。" * 6
    df = rows([(1, text, "new", ""), (2, None, None, ""), (3, "", None, ""), (4, " \n", None, ""), (5, text, "new", ""), (6, text * 3000, None, "")], "doc_id bigint, text string, source string, subject string")
    assert sorted(map(tuple, subjects.assign_subjects(df, model).collect())) == [(1, "sport"), (5, "sport"), (6, "sport")]
    assert subjects.assign_subjects(df, subjects.train([])).count() == 0 and subjects.assign_subjects(df.limit(0), model).count() == 0
    labels = rows([(1, "sport"), (1, "sport"), (2, None), (None, "x"), (99, "y")], "doc_id bigint, subject string")
    got = subjects.labelled_sample(df, labels, 10)
    assert sorted((len(t), sorted(own)) for t, _, own in got) == [(0, []), (len(text), ["sport"])]


def test_found_queries(spark):
    from prefengine.llm import queries

    con = connect(DATA)
    for name, f in queries.queries().items():
        df = f(spark, DATA)
        if name in queries.oracle_sql():
            same(df, con, queries.oracle_sql()[name])
        else:
            rows = df.collect()
            assert rows and (not name.endswith("_found") or len({tuple(r) for r in rows}) == len(rows)), name
    assert np.all([n.startswith("p") for n in queries.queries()])
