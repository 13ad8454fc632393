import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefengine.llm import leakage, neardup, splits
from prefengine.llm._packed import pack48, packed_parts, text_hash, to_bytes, to_text, unpack48, unpacked
from prefengine.llm._sketch import order_sketches
from prefengine.llm._text import fold, trigram_similarity


def corpus(seed, groups=25, swaps=True, alphabet="甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇宙洪荒日月盈昃"):
    """Texts in groups of small edits and swaps of a base."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(12, 30))) for _ in range(rng.randint(3, 6))]
        for _ in range(rng.randint(1, 6)):
            p = list(parts)
            if swaps and rng.random() < 0.5:
                rng.shuffle(p)
            t = list("，".join(p))
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(alphabet)
            out.append("".join(t))
    return out


def test_fold():
    assert fold(None) == fold("") == fold("，。 !") == ""
    assert fold("Ａb①，é é㈱") == "ab1éé株" and fold("ABC 你好，１２") == "abc你好12"


def test_packing():
    a, b = np.array([2**64 - 1, 5, 7], np.uint64), np.array([1, 2, 3], np.uint64)
    assert (unpack48(pack48(a)) == a & np.uint64(2**48 - 1)).all()
    k, d = unpacked([x for _, x in packed_parts(a, b, 4)])
    assert sorted(zip(k.tolist(), d.tolist())) == sorted(zip((a & np.uint64(2**48 - 1)).tolist(), b.tolist()))
    assert to_text(to_bytes("你好a😀éß")) == "你好a😀éß"


def test_sketches_need_order_and_repeats():
    a, b = "".join(chr(0x4e00 + i) for i in range(60)), "".join(chr(0x4e00 + i) for i in range(59, -1, -1))
    k = order_sketches([a, a, b, "哈" * 60, "哈" * 90], 4, 4, 16, 64)
    assert (k[0] == k[1]).all() and not (k[0] == k[2]).any() and not (k[3] == k[0]).any()
    assert order_sketches(["天地玄黄宇宙洪"], 4, 4, 3, 64).shape == (1, 3)


def brute(texts, least):
    f = [fold(t) for t in texts]
    return {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if len(f[i]) >= 40 <= len(f[j]) and trigram_similarity(f[i], f[j]) >= least}


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_against_brute_force(rows, seed):
    texts = corpus(seed)
    df = rows([(i, t[:20], t[20:], "x") for i, t in enumerate(texts)], "i bigint, q string, a string, text string")
    got = [(r["record_a"], r["record_b"]) for r in neardup.near_duplicates(df, "i", ["q", "a"], 0.7).collect()]
    want = brute(texts, 0.7)
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.96 * len(want)


def test_crowded_keys_lose_nothing(rows):
    texts = corpus(9, groups=3)
    df = rows([(i, t) for i, t in enumerate(texts)], "i bigint, q string")
    a = set(map(tuple, neardup.near_duplicates(df, "i", ["q"], 0.7).select("record_a", "record_b").collect()))
    b = set(map(tuple, neardup.near_duplicates(df, "i", ["q"], 0.7, hot=1).select("record_a", "record_b").collect()))
    c = set(map(tuple, neardup.near_duplicates(df, "i", ["q"], 0.7, split=-1).select("record_a", "record_b").collect()))  # whatever the sample has is kept apart
    assert a == b == c and a


def test_a_template_in_a_third_of_the_rows(rows):
    """Texts of one template that differ elsewhere: the crowded keys are compared by their rarest trigrams."""
    rng = random.Random(21)
    letters = [chr(0x4e00 + i) for i in range(3000)]
    stem = "".join(rng.choice(letters) for _ in range(40))
    texts = [stem + "".join(rng.choice(letters) for _ in range(40)) for _ in range(200)] + ["".join(rng.choice(letters) for _ in range(80)) for _ in range(400)]
    texts += [_edited(rng, t, 3, letters) for t in texts[:100]]
    df = rows(list(enumerate(texts)), "i bigint, q string")
    got = [set(map(tuple, neardup.near_duplicates(df, "i", ["q"], 0.7, **how).select("record_a", "record_b").collect())) for how in ({"hot": 10}, {"split": -1})]
    want = brute(texts, 0.7)
    assert all(g <= want and len(g) >= 0.99 * len(want) for g in got) and len(want) >= 100


def test_texts_that_share_an_id_keep_their_own_links(rows):
    texts = corpus(5, groups=12)
    df = rows(list(enumerate(texts)) + [(500 + i, t) for i, t in enumerate(texts[:9])], "i bigint, q string")
    same = {(i, j) for i in range(9) for j in range(500, 509) if fold(texts[i]) == fold(texts[j - 500])}
    h = text_hash([fold(t) for t in texts], 3)
    for bits in (3, 48):  # with 3 bits texts are told apart by the rest of their hash alone
        got = {(r["record_a"], r["record_b"]): r["similarity"] for r in neardup.near_duplicates(df, "i", ["q"], 0.7, bits=bits).collect()}
        plain = {p: s for p, s in got.items() if p[1] < 500}
        assert set(plain) <= brute(texts, 0.7) and all(abs(s - trigram_similarity(fold(texts[a]), fold(texts[b]))) < 1e-9 for (a, b), s in plain.items())
        assert same <= set(got) and all(h[a] != h[b] or fold(texts[a]) == fold(texts[b]) for a, b in plain if bits == 3)
    a, b = ({(x["train_id"], x["val_id"]) for x in splits.split_overlaps(df.filter("i % 2 = 0"), df.filter("i % 2 = 1"), "i", F.col("q"), 0.7, bits=n).collect()} for n in (3, 48))
    assert a <= b and b


def test_near_duplicate_edges(rows):
    long = "".join(chr(0x4e00 + i % 3000) for i in range(50_000))
    base = corpus(1, groups=1)[0] + "尾巴" * 10
    data = [(1, base, None), (1, base, None), (2, base, ""), (3, None, None), (4, "短", "文"), (None, base, None), (5, long, ""), (6, long[:-5], "")]
    df = rows(data, "i bigint, q string, a string")
    got = sorted((r["record_a"], r["record_b"], round(r["similarity"], 2)) for r in neardup.near_duplicates(df, "i", ["q", "a"], 0.7).collect())
    assert got == [(1, 2, 1.0), (5, 6, 1.0)]
    assert neardup.near_duplicates(df.limit(0), "i", ["q", "a"]).count() == 0
    assert neardup.near_duplicates(df, "i", ["q", "a"], 0.9, verify="alignment").count() == 2


def test_banded_edits():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in "xy")
        d = full(a, b)
        assert neardup.banded_edits(a, b, 9) == d and neardup.banded_edits(a, b, d - 1) is None


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_against_brute_force(rows, seed):
    texts = corpus(seed + 50)
    train, held = texts[::2], texts[1::2]
    conv = lambda t: [("system", "不算"), ("user", t[:15]), ("gpt", t[15:]), ("gpt", None)]
    kind = "id string, conversations array<struct<from:string,value:string>>, similarity int"
    a = rows([(f"t{i}", conv(t), 0) for i, t in enumerate(train)] + [("t0", conv(train[0]), 0), ("n", None, 0), ("e", [], 0)], kind)
    b = rows([(f"v{i}", conv(t), 0) for i, t in enumerate(held)] + [("n", None, 0)], kind)
    out = splits.split_overlaps(a, b, "id", splits.conversation_text(), 0.7).collect()
    got = {(r["train_id"], r["val_id"]) for r in out}
    want = {(f"t{i}", f"v{j}") for i, x in enumerate(train) for j, y in enumerate(held) if trigram_similarity(fold(x), fold(y)) >= 0.7 and min(len(fold(x)), len(fold(y))) >= 40}
    assert len(out) == len(got) and got <= want and len(got) >= 0.98 * len(want)
    assert all(0 <= r["coverage_val"] <= 1 and 0 <= r["coverage_train"] <= 1 for r in out)
    assert splits.split_overlaps(a.limit(0), b, "id", splits.conversation_text()).count() == 0


def test_conversation_text(rows):
    df = rows([([("system", "x"), (None, "a"), ("user", None), ("gpt", "b")],), (None,), ([None],)], "conversations array<struct<from:string,value:string>>")
    assert [r[0] for r in df.select(splits.conversation_text()).collect()] == ["ab", None, ""]


def test_winnowing_guarantee():
    rng = random.Random(4)
    for _ in range(100):
        common = "".join(rng.choice("abcdef") for _ in range(23))
        a, b = ("".join(rng.choice("abcdef") for _ in range(30)) + common + "".join(rng.choice("abcdef") for _ in range(30)) for _ in "xy")
        h, owner, _ = splits.winnow([a, b], 8, 16)
        assert set(h[owner == 0].tolist()) & set(h[owner == 1].tolist())
    h, owner, _ = splits.winnow(["abcdefghij", "", "abc"], 8, 16)
    assert owner.tolist() == [0]


def test_chains():
    assert splits.collinear_chain([(0, 5), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)] and splits.collinear_chain([]) == []
    t = "".join(chr(0x4e00 + i) for i in range(100))
    assert splits.chain_coverage(t, t, 8, 16) == (1.0, 1.0)
    # one letter replaced, one put in: the gaps are aligned, so only the edits are left out
    other = t[:30] + "Z" + t[31:60] + "Y" + t[60:]
    assert splits.chain_coverage(t, other, 8, 16) == (0.99, 99 / 101)
    assert splits.gap_matches("abcd", "axcd") == 3 and splits.gap_matches("", "a") == 0 and splits.gap_matches("ab" * 50, "ba" * 50) == 99


@pytest.mark.parametrize("edits", [0, 2])
def test_leaks_against_brute_force(rows, edits):
    rng = random.Random(6)
    alphabet = "abcdefgh天地玄黄"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, text(80)) for i in range(8)]
    docs = []
    for d in range(40):
        i = rng.randrange(8)
        n = rng.choice([30, 39, 40, 41, 60])
        at = rng.randrange(80 - n)
        piece = list(items[i][1][at:at + n])
        if edits and n > 45:
            piece[n // 2] = "Z"
        docs.append((d, text(rng.randint(0, 50)) + " ,".join("".join(piece)) + text(20)))
    got = leakage.leaked_passages(rows(docs + [(90, None), (91, ""), (92, docs[0][1])], "doc_id bigint, text string").withColumn("item_id", F.lit(1)), rows(items, "item_id bigint, text string"),
                                  edits=edits, q=16 if not edits else 8).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    want = {(d, i) for d, t in docs for i, x in items if any(x[p:p + 40] in fold(t) for p in range(len(x) - 39))}
    assert want <= {p for p in pairs if p[0] < 90} and {i for d, i in pairs if d == 92} == {i for d, i in pairs if d == 0}
    if not edits:
        assert {p for p in pairs if p[0] < 90} == want
        assert all(r["shared"] >= 40 and r["edits"] == 0 for r in got)
    else:
        assert all(r["edits"] <= 2 for r in got)


@pytest.mark.parametrize("edits, q", [(0, 16), (2, 8)])
def test_leaks_by_joins_equal_those_by_index(rows, edits, q):
    rng = random.Random(7)
    alphabet = "abcdefgh天地玄黄"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, text(rng.choice([30, 40, 60, 90]))) for i in range(12)]
    items += [(50, items[3][1]), (None, items[3][1])]
    docs = [(d, text(rng.randint(0, 60)) + _edited(rng, items[d % 12][1], rng.randint(0, 2), "Z") + text(9), 1) for d in range(40)] + [(None, items[3][1], 1), (60, None, 1), (61, "", 1)]
    d, i = rows(docs, "doc_id bigint, text string, item int"), rows(items, "item_id bigint, text string")
    one, joined = (sorted(map(tuple, leakage.leaked_passages(d, i, edits=edits, q=q, max_index_chars=n, filter_bits=1 << 16).collect())) for n in (10**6, 0))
    assert one == joined and one and all(r[0] is not None and r[1] is not None for r in one)
    assert leakage.leaked_passages(d.limit(0), i).count() == 0 and leakage.leaked_passages(d, i.limit(0)).count() == 0


def test_the_band_count_decides_what_is_aligned(monkeypatch):
    """Without the lemma's count every chance hit would be aligned."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ab") for _ in range(n))
    items, doc = [(0, text(400))], text(4000)
    tries = []
    monkeypatch.setattr(leakage, "aligned", lambda *x, f=leakage.aligned: tries.append(x) or f(*x))
    lemma = leakage.Lemma(40, 2, 8)
    assert (lemma.step, lemma.bound) == (3, 4) and leakage.Lemma(40, 0, 16).bound == 3
    found = leakage.PassageIndex(items, lemma).search(doc)
    some, lemma.bound = len(tries), 1
    assert leakage.PassageIndex(items, lemma).search(doc) == found and len(tries) > 3 * some


def test_groups(rows):
    texts = corpus(4, groups=6) + ["短", None]
    df = rows([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (90, texts[0])], "i bigint, q string")
    out = {r["record"]: (r["group"], r["links"]) for r in neardup.duplicate_groups(df, "i", ["q"], 0.7).collect()}
    pairs = [(r["record_a"], r["record_b"]) for r in neardup.near_duplicates(df, "i", ["q"], 0.7).collect()]
    assert len(out) == len(texts) + 1
    root = {i: i for i in out}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {i: g for i, (g, _) in out.items()} == {i: find(i) for i in out}
    assert out[len(texts) - 1] == (len(texts) - 1, 0) and out[90][0] == out[0][0] and out[90][1] == out[0][1]
    assert neardup.duplicate_groups(df.limit(0), "i", ["q"]).count() == 0


def test_overlap_counts(rows):
    links = rows([("t1", "v1", 0.5), ("t2", "v1", 1.0), ("t3", "v2", 1.0)], "train_id string, val_id string, coverage_val double")
    train = rows([("t1", "a"), ("t1", "a"), ("t2", "a"), ("t3", None)], "id string, source string")
    held = rows([("v1", "test", "x"), ("v2", "val", "x"), ("v3", "val", "x")], "id string, split string, source string")
    got = {tuple(r) for r in splits.overlap_counts(links, train, held, "id", "split", "source").collect()}
    assert got == {("test", "x", "a", 1, 2, 0.75), ("val", "x", None, 1, 1, 1.0)}


def _edited(rng, base, edits, letters):
    t = list(base)
    for p in rng.sample(range(len(t)), edits):
        t[p] = rng.choice(letters)
    return "".join(t)


def test_frequent_fingerprints_lose_nothing(rows):
    """Groups of more than 16 edited training texts: every pair that shares any fingerprint is found."""
    rng = random.Random(12)
    letters = [chr(0x4e00 + i) for i in range(2000)]
    train, held = [], []
    for n in (50, 60, 70, 80):
        base = "".join(rng.choice(letters) for _ in range(n))
        train += [_edited(rng, base, 2, letters) for _ in range(40)]
        held += [_edited(rng, base, 3, letters) for _ in range(20)]
    a, b = ([set(splits.winnow([t], 8, 16)[0].tolist()) for t in x] for x in (train, held))
    want = {(i, j) for i, x in enumerate(train) for j, y in enumerate(held) if a[i] & b[j] and trigram_similarity(x, y) >= 0.7}
    ids = [rows(list(enumerate(x)), "id bigint, text string").repartition(1) for x in (train, held)]
    for rare in ({}, {"rare": 0}, {"rare": 10**6}, {"split": -1}):  # it only chooses the way
        out = splits.split_overlaps(*ids, "id", F.col("text"), 0.7, **rare).collect()
        assert {(r["train_id"], r["val_id"]) for r in out} == want and len(out) == len(want)


def test_parity_sketches():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh天😀") for _ in range(rng.randint(3, 60))) for _ in range(40)] + ["", "ab"]
    grams, owner = splits.distinct_trigrams(texts)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len({t[i:i + 3] for i in range(len(t) - 2)}) for t in texts]
    assert all((splits.parity_sketches([t]) == x).all() for t, x in zip(texts, splits.parity_sketches(texts)))
    wide = ["".join(chr(0x20000 + i) for i in range(30_000)), "".join(chr(0xac00 + i) for i in range(9_000)), "一二三一二三"] * 3
    assert [len(np.unique(x)) for x in (splits.distinct_trigrams(wide)[1],)] == [9] and (splits.parity_sketches(wide)[2] == splits.parity_sketches(["一二三一二三"])[0]).all()


def test_a_copied_training_text_counts_once(rows):
    """One training text under 60 ids in over 16 partitions, against an edited copy with a common fingerprint but no three in a row."""
    rng = random.Random(5)
    letters = [chr(0x4e00 + i) for i in range(2000)]
    while True:
        base = "".join(rng.choice(letters) for _ in range(70))
        other = _edited(rng, base, 3, letters)
        a, b = (splits.winnow([t], 8, 16)[0].tolist() for t in (base, other))
        threes = [{tuple(x[i:i + 3]) for i in range(len(x) - 2)} for x in (a, b)]
        if set(a) & set(b) and not threes[0] & threes[1] and min(len(a), len(b)) > 3 and trigram_similarity(base, other) >= 0.7:
            break
    train = rows([(i, base) for i in range(60)], "id bigint, text string").repartition(60, "id")
    out = splits.split_overlaps(train, rows([(0, other)], "id bigint, text string"), "id", F.col("text"), 0.7).collect()
    assert sorted(r["train_id"] for r in out) == list(range(60))
    h, owner, _ = splits.winnow([base], 8, 16)
    chunks = [x for _ in range(20) for _, x in packed_parts(h, text_hash([base])[owner], 1, splits.parity_sketches([base])[owner])]
    assert len(splits._side(chunks)[0]) == len(set(h.tolist()))
