import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefengine.operators import dedup, families, graph


def test_keep_best_and_ties(rows):
    df = rows([(1, "k", "aa"), (2, "k", "aaa"), (3, "k", "bbb"), (4, "m", ""), (5, None, "x")], "i bigint, k string, a string")
    out = dedup.keep_best(df, ["k"], [F.length("a"), -F.col("i")], "i")
    got = {r["i"]: r["duplicate_of"] for r in out.collect()}
    assert got == {1: 2, 2: None, 3: 2, 4: None}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_survivors_equal_a_scan(rows, seed):
    rng = random.Random(seed)
    n = 30
    edges = {(b, a) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.1}  # (loser, winner), lower is better
    kept = []
    for i in range(n):
        if not any((i, k) in edges for k in kept):
            kept.append(i)
    df = rows([(i,) for i in range(n)], "i bigint")
    out = dedup.greedy_survivors(df, rows(sorted(edges) or [(0, 0)], "loser bigint, winner bigint"), "i")
    assert sorted(r["i"] for r in out.filter("kept").collect()) == kept
    assert out.count() == n


def test_fuzzy_dedup_equals_a_scan(rows):
    rng = random.Random(3)
    base = ["请问这个商品什么时候可以发货呢我很着急", "能不能开增值税专用发票给公司报销使用"]
    data = []
    for i in range(40):
        q, a = rng.choice(base), "".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(3)) + "您好这边为您核实一下订单的具体情况请稍等片刻谢谢"
        data.append((i, q if rng.random() < 0.7 else q[:-1] + "吧", a, -len(a), -len(q), i))
    df = rows(data, "i bigint, q string, a string, r1 int, r2 int, r3 int")
    def keys(q):
        band = min(len(q) // 4, 50)
        return {("p", band, q[:8]), ("s", band, q[-8:])}
    sim = lambda x, y: SequenceMatcher(None, x, y).ratio()
    kept = []
    for i, q, a, *rank in sorted(data, key=lambda r: r[3:]):
        if not any(keys(q) & keys(kq) and sim(q, kq) >= 0.96 and (sim(a, ka) >= 0.92 or sim(f"{q}||{a}", f"{kq}||{ka}") >= 0.95) for _, kq, ka in kept):
            kept.append((i, q, a))
    df = df.withColumns({"r1": -F.col("r1"), "r2": -F.col("r2"), "r3": -F.col("r3")})
    out = dedup.fuzzy_dedup(df, "i", "q", "a", ["r1", "r2", "r3"])
    assert sorted(r["i"] for r in out.filter("kept").collect()) == sorted(i for i, *_ in kept)


def test_near_texts_equal_all_pairs(rows):
    rng = random.Random(8)
    base = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(n)) for n in (1, 2, 5, 13, 26, 40, 60, 120, 230, 300)]
    texts = set(base)
    for t in base:
        for _ in range(12):
            x = list(t)
            for _ in range(rng.randint(1, max(1, len(t) // 25))):
                at = rng.randrange(len(x))
                x[at:at + 1] = rng.choice([[], [x[at], rng.choice("甲乙丙")], [rng.choice("甲乙丙")]])
                x = x or ["甲"]
            texts.add("".join(x))
    def keys(q):
        band = min(len(q) // 4, 50)
        return {("p", band, q[:8]), ("s", band, q[-8:])}
    want = {(a, b) for a in texts for b in texts if keys(a) & keys(b) and SequenceMatcher(None, a, b).ratio() >= 0.96}
    got = {(r["ta"], r["tb"]) for r in dedup.near_texts(rows([(t,) for t in texts], "t string"), "t", 0.96).collect()}
    assert got == want and len(want) > len(texts)


def test_sparse_matches_equal_all_pairs(rows):
    rng = random.Random(5)
    data = [(i, "".join(rng.choice("abcd" if i % 2 else "abcdefgh") for _ in range(rng.randint(0, 14)))) for i in range(60)]
    w = graph.char_tfidf(rows(data, "i bigint, t string"), "i", "t")
    vec = {}
    for r in w.collect():
        vec.setdefault(r["i"], {})[r["gram"]] = r["weight"]
    for least in (0.3, 0.72):
        got = {(r["q"], r["r"]): r["score"] for r in graph.sparse_matches(w.withColumnRenamed("i", "q"), w.withColumnRenamed("i", "r"), "q", "r", least, 100).collect()}
        dot = {(a, b): sum(x * vec[b].get(g, 0.0) for g, x in vec[a].items()) for a in vec for b in vec}
        assert set(got) == {p for p, s in dot.items() if s >= least} and all(abs(got[p] - dot[p]) < 1e-9 for p in got)


def test_block_keys(rows):
    got = [r[0] for r in rows([("",), ("abcdefghij",)], "t string").select(dedup.block_keys("t")).collect()]
    assert got == [["empty"], ["p:2:abcdefgh", "s:2:cdefghij"]]


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(rows, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)] + [(i, i + 1) for i in range(40, 55)]
    root = list(range(n))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = graph.connected_components(rows([(i,) for i in range(n)], "i bigint"), rows(edges, "src bigint, dst bigint"), "i")
    assert {r["node"]: r["component"] for r in out.collect()} == {i: find(i) for i in range(n)}
    numbers = graph.number_clusters(out).orderBy("cluster_id").collect()
    assert [r["cluster_id"] for r in numbers] == list(range(len(numbers)))
    assert all(a["size"] >= b["size"] for a, b in zip(numbers, numbers[1:]))


def test_no_edges(rows):
    out = graph.connected_components(rows([(1,), (2,)], "i bigint"), rows([], "src bigint, dst bigint"), "i")
    assert sorted((r[0], r[1]) for r in out.collect()) == [(1, 1), (2, 2)]


def test_key_edges_are_a_star(rows):
    df = rows([(1, "a"), (2, "a"), (3, "a"), (4, None), (5, "b")], "i bigint, k string")
    assert sorted((r["src"], r["dst"]) for r in graph.key_edges(df, "i", F.col("k")).collect()) == [(1, 2), (1, 3)]


@pytest.mark.parametrize("least", [0.2, 0.8, 0.95])
def test_similar_vectors_are_exact(rows, least):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(120, 6))
    m[60:] = m[:60] + rng.normal(scale=0.15, size=(60, 6))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] >= least}
    df = rows([(i, [float(x) for x in m[i]]) for i in range(120)], "i bigint, v array<double>")
    got = [(r["src"], r["dst"]) for r in graph.similar_vectors(df, "i", "v", least, block_rows=10).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_vectors_in_cells(rows):
    """Few of the pairs are compared, and those at the threshold are met with the recall asked for."""
    assert graph.cell_plan(0.35, 0.99) == (0, 1)  # nothing to gain: exact
    for least, most in ((0.83, 0.25), (0.95, 0.02)):
        bits, tables = graph.cell_plan(least, 0.99)
        assert tables / 2 ** bits < most
    rng = np.random.default_rng(8)
    m = rng.normal(size=(600, 32))
    m[300:] = m[:300] + rng.normal(scale=0.3, size=(300, 32))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if u[i] @ u[j] >= 0.95}
    df = rows([(i, [float(x) for x in m[i]]) for i in range(600)], "i bigint, v array<double>")
    for size in (8_000, 7):
        got = [(r["src"], r["dst"]) for r in graph.similar_vectors(df, "i", "v", 0.95, recall=0.99, block_rows=size).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want) and len(want) > 100


def test_similar_vectors_of_nothing(rows):
    assert graph.similar_vectors(rows([], "i bigint, v array<double>"), "i", "v", 0.5).count() == 0


def test_nearest_in_blocks(rows):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(80, 4))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = rows([(i, [float(x) for x in m[i]]) for i in range(80)], "i bigint, v array<double>")
    got = graph.nearest(df.filter("i % 10 = 0"), df, "i", "v", 3, -1.0, block=3).collect()
    for i in range(0, 80, 10):
        s = u @ u[i]
        s[i] = -9
        assert {r["dst"] for r in got if r["src"] == i} == set(np.argsort(-s)[:3].tolist())


def test_merged_families(rows):
    data = [(1, 1, "支持退货请联系客服处理", "支持退货请联系客服处理", "positive"), (1, 2, "支持退货请联系客服", "支持退货请联系客服", "positive"),
            (1, 3, "不支持退货请联系客服", "不支持退货请联系客服", "negative"), (2, 4, "好", "好", "unknown")]
    df = rows(data, "c bigint, i bigint, a string, n string, stance string")
    got = {r["i"]: r["family"] for r in families.merged_families(df, "c", "i", "a", "n").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}


def test_contradictions(rows):
    data = [(1, 0, 3, 2.0, "3-5天到", "unknown", "delivery_time"), (1, 1, 2, 1.0, "10-15天到", "unknown", "delivery_time"), (1, 2, 1, 1.0, "4天到", "unknown", "delivery_time"),
            (2, 0, 3, 2.0, "支持发票", "positive", "invoice"), (2, 1, 1, 1.0, "不支持发票", "negative", "invoice"), (2, 2, 1, 0.9, "如果满额不支持", "negative", "invoice"),
            (3, 0, 1, 2.0, "支持", "positive", "invoice"), (3, 1, 1, 1.0, "不支持", "negative", "invoice")]
    from prefengine.functions.rules import time_ranges

    df = rows(data, "c bigint, family int, support bigint, score double, rep_answer string, stance string, kind string").withColumn("ranges", time_ranges(F.col("rep_answer")))
    out = families.contradictions(families.ranked_families(df, "c"), "c", "kind", ["delivery_time"], ["invoice"])
    got = {(r["c"], r["family"]): r["contradiction"] for r in out.collect()}
    assert got == {(1, 0): None, (1, 1): "non_overlapping_time_ranges", (1, 2): None, (2, 0): None, (2, 1): "policy_conflict:positive->negative", (2, 2): None,
                   (3, 0): None, (3, 1): None}
    kept, cut_off = families.top_families(out, "c", 1)
    assert (kept.count(), cut_off.count()) == (3, 3)


def test_consolidated_and_records(rows):
    fam = rows([(7, "pickup", 0, 11, "甲", 2, 1.0, "positive"), (7, "pickup", 1, 12, "乙", 1, 0.5, "unknown")],
               "c bigint, kind string, family int, rep bigint, rep_answer string, support bigint, score double, stance string")
    one = families.consolidated(fam, "c", "kind", rows([("pickup", "如果需要自提请联系客服")], "kind string, text string")).collect()
    assert len(one) == 1 and one[0]["support"] == 3 and one[0]["score"] == pytest.approx(1.4) and one[0]["stance"] == "conditional"
    variants = rows([(7, 0, 1, 11, "能自提吗"), (7, 0, 2, 12, "可以自提吗")], "c bigint, family int, place int, i bigint, q string")
    got = families.records_of(variants, fam.filter("family = 0"), "c", "q").orderBy("id").collect()
    assert [r["id"] for r in got] == ["cluster_00007_ans_00_q_00", "cluster_00007_ans_00_q_01"]
    assert got[0]["conversations"][0]["value"] == "能自提吗"


def test_hour_window(rows):
    df = rows([([(0.0, 24.0), (24.0, 72.0), (48.0, 96.0)],), ([],)], "r array<struct<lo:double,hi:double>>")
    a, b = [r[0] for r in df.select(families.hour_window(F.col("r"), 0.5)).collect()]
    assert (a["lo"], a["hi"]) == (pytest.approx(27.6), 72.0) and (b["lo"], b["hi"]) == (None, None)
    n = rows([(0.0,), (5.2,), (25.0,), (0.3,)], "h double")
    assert [tuple(r) for r in n.select(families.rounded_hours(F.col("h"), True), families.rounded_hours(F.col("h"), False)).collect()] == [(0, 0), (6, 5), (48, 24), (1, 1)]


def test_ranks_without_one_task(rows):
    from prefengine.plans.ordering import global_rank, group_rank, running_total

    rng = random.Random(2)
    data = [(i, rng.choice(["a", "b", None]), rng.randrange(50)) for i in range(300)]
    df = rows(data, "i bigint, g string, v int").repartition(7)
    order = [F.col("v"), F.col("i")]
    want = {i: n for n, (_, i) in enumerate(sorted((v, i) for i, _, v in data), 1)}
    assert {r["i"]: r["n"] for r in global_rank(df, order, "n").collect()} == want
    a = {(r["i"], r["n"]) for r in group_rank(df, "g", order, "n", most=0).collect()}
    assert a == {(r["i"], r["n"]) for r in group_rank(df, "g", order, "n").collect()} and len(a) == 300
    last = max(running_total(df, order, F.col("v"), "n").collect(), key=lambda r: (r["v"], r["i"]))
    assert last["n"] == sum(v for *_, v in data)
    assert group_rank(df.limit(0), "g", order, "n").count() == 0 and global_rank(df.limit(0), order, "n").count() == 0


def test_nearest_cuts_equal_scores_by_dst(rows):
    df = rows([(i, [1.0, 0.0]) for i in range(40, 0, -1)], "i bigint, v array<double>").coalesce(1)
    got = graph.nearest(df.filter("i = 40"), df, "i", "v", 3, -1.0).collect()
    assert sorted(r["dst"] for r in got) == [1, 2, 3]


def test_a_question_of_many_answers(rows):
    """The edges equal those of all pairs, and few pairs of the one question are met."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    words = [chr(0x4e00 + i) for i in range(400)]
    said = ["".join(rng.choice(words) for _ in range(rng.randint(8, 40))) for _ in range(60)]
    said += ["".join(c if rng.random() > 0.04 else rng.choice(words) for c in a) for a in said[:40]]
    q = "这个问题有很多不同的回答应该怎么办才好呀"  # with one letter more still of the same length band
    data = [(i, q if i % 5 else q + "呢", a, -i) for i, a in enumerate(dict.fromkeys(said))]
    got = {r["idx"] for r in dedup.fuzzy_dedup(rows(data, "idx int, q string, a string, r int"), "idx", "q", "a", ["r"]).filter("kept").collect()}
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    kept = []
    for i, qi, a, _ in data:
        if not any(ratio(a, b) >= 0.92 or ratio(f"{qi}||{a}", f"{qj}||{b}") >= 0.95 for _, qj, b, _ in kept):
            kept.append((i, qi, a, 0))
    assert got == {k[0] for k in kept} and len(got) < len(data)


def test_funnel_in_one_pass(rows):
    df = rows([("a", True), ("a", True), ("b", True), ("c", False)], "q string, k boolean")
    got = [tuple(r) for r in dedup.filter_funnel(df, F.col("k"), [F.col("q")]).collect()]
    assert got == [(0, "raw", 4), (1, "after_filter", 3), (2, "after_exact_dedup", 2)]
    assert [r["rows"] for r in dedup.filter_funnel(df.limit(0), F.col("k"), [F.col("q")]).collect()] == [0, 0, 0]


def _varied(rng, text, letters, share):
    out = [rng.choice([c + rng.choice(letters), "", rng.choice(letters)]) if rng.random() < share else c for c in text]
    return "".join(out) or text


@pytest.mark.parametrize("crowd", [1, 512])
def test_fuzzy_dedup_equals_a_scan_whatever_is_crowded(rows, crowd, monkeypatch):
    """Only crowded blocks and questions are cut into character pairs; the rows are the same either way."""
    if crowd > 1:
        monkeypatch.setattr(dedup, "prefix_pairs", lambda *_: pytest.fail("character pairs of texts that are not crowded"))
    rng = random.Random(12)
    letters = [chr(0x4e00 + i) for i in range(300)]
    asked = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 9, 30, 52, 210)]
    said = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 60))) for _ in range(25)]
    data = dict.fromkeys((_varied(rng, rng.choice(asked), letters, 0.02), _varied(rng, rng.choice(said), letters, 0.03)) for _ in range(350))
    data = [(i, q, a, -i) for i, (q, a) in enumerate(data)]
    def keys(q):
        band = min(len(q) // 4, 50)
        return {("p", band, q[:8]), ("s", band, q[-8:])}
    near = lambda x, y, least: 2 * min(len(x), len(y)) >= least * (len(x) + len(y)) and SequenceMatcher(None, x, y).ratio() >= least
    kept = []
    for i, q, a, _ in data:
        if not any(keys(q) & keys(p) and near(q, p, 0.96) and (near(a, b, 0.92) or near(f"{q}||{a}", f"{p}||{b}", 0.95)) for _, p, b in kept):
            kept.append((i, q, a))
    odd = [(1000, None, "x", 0), (1001, None, "x", 0), (1002, "x", None, 0)]  # an unknown text is near none
    got = dedup.fuzzy_dedup(rows(data + odd, "idx int, q string, a string, r int"), "idx", "q", "a", ["r"], crowd=crowd).collect()
    assert sorted(r["idx"] for r in got) == [*range(len(data)), 1000, 1001, 1002]
    assert {r["idx"] for r in got if r["kept"]} == {i for i, *_ in kept} | {1000, 1001, 1002} and len(kept) < len(data) * 0.9


def test_near_texts_of_crowded_blocks(rows):
    rng = random.Random(4)
    letters = [chr(0x4e00 + i) for i in range(40)]
    start = "退款什么时候到账"
    texts = {start + _varied(rng, "".join(letters[:n]), letters, 0.06) for n in (12, 20, 32) for _ in range(150)}
    def keys(q):
        return {("p", len(q) // 4, q[:8]), ("s", len(q) // 4, q[-8:])}
    want = {(a, b) for a in texts for b in texts if keys(a) & keys(b) and SequenceMatcher(None, a, b).ratio() >= 0.96}
    for crowd in (1, 512):
        got = [(r["ta"], r["tb"]) for r in dedup.near_texts(rows([(t,) for t in texts], "t string"), "t", 0.96, crowd).collect()]
        assert set(got) == want and len(got) == len(want) > len(texts) + 200


def test_parities_differ_in_at_most_the_unmatched(rows):
    rng = random.Random(2)
    data = []
    for _ in range(300):
        a = "".join(rng.choice("甲乙丙丁戊😀ab|") for _ in range(rng.randint(0, 40)))
        data.append((a, _varied(rng, a, "甲乙丙子", 0.1)))
    df = rows(data, "a string, b string").select("a", "b", dedup.parities("a").alias("x"), dedup.parities("b").alias("y"), dedup.parities(F.concat("a", F.lit("||"), "b")).alias("z"))
    bits = lambda r: (r["s0"] & (1 << 64) - 1, r["s1"] & (1 << 64) - 1)
    for r in df.collect():
        x, y, z = bits(r["x"]), bits(r["y"]), bits(r["z"])
        unmatched = len(r["a"]) + len(r["b"]) - 2 * sum(m.size for m in SequenceMatcher(None, r["a"], r["b"], autojunk=False).get_matching_blocks())
        assert sum((p ^ q).bit_count() for p, q in zip(x, y)) <= unmatched
        assert (x[0] ^ y[0], x[1] ^ y[1]) == z  # the two bars between them cancel


def test_best_of_is_one_row_for_each_key(rows):
    df = rows([("q", "a", 5, -2), ("q", "a", 5, -1), ("q", "a", 5, -1), ("q", "b", 1, -3), ("", "", 9, -4)], "q string, a string, r1 int, r2 int")
    assert sorted(tuple(r) for r in dedup.best_of(df, ["q", "a"], ["r1", "r2"]).collect()) == [("", "", 9, -4), ("q", "a", 5, -1), ("q", "b", 1, -3)]
