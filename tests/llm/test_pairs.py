import pytest

from prefengine.llm import pairs
from prefengine.llm.pairs import broken_pairs, copies_question, defect_of, is_truncated, language, tiles, within_runs

Q = "请问北屿保温杯可以机洗吗，我买了3件。"
CASES = [
    (None, "empty"), ("", "empty"), ("  \n", "empty"), ("<think>先想想</think>", "empty"), ("&nbsp;<br/>", "empty"), ("null", "empty"), ("（无内容）", "empty"), ("……", "empty"), ("​﻿", "empty"),
    (Q, "copies_question"), ("问题：" + Q, "copies_question"), ("您问的是：“" + Q + "”", "copies_question"), (Q + Q, "copies_question"), (Q.replace("我", "您"), "copies_question"),
    ("请问北屿保温杯可以机洗吗，我买了３件", "copies_question"), ("您问“" + Q + "”，可以机洗的，请放心使用，水温不要超过四十度。", None),
    ("抱歉，我无法回答这个问题。", "refusal"), ("I'm sorry, but I can't help with that.", "refusal"), ("关于库存，恕我不能作答。", "refusal"), ("此类内容不在我的服务范围之内，无可奉告。", "refusal"),
    ("抱歉，这款杯子不支持机洗，建议手洗。", None), ("超出13天就不能无理由退货了，不过质量问题仍可申请检测。", None), ("请您联系客服小舟处理。", None),
    ("Your order will be sent in 3 days. You can follow it with the number.", "other_language"), ("ご注文番号を確認しました。", "other_language"), ("주문하신 상품은 발송됩니다.", "other_language"),
    ("Ваш заказ будет отправлен.", "other_language"), ("Votre commande est en cours pour vous.", "other_language"),
    ("可以机洗的，不过建议您先", "truncated"), ("可以的，有两种方案：方案一，换新；方案二，", "truncated"), ("请按步骤：1. 打开订单；2.", "truncated"), ("参数为（重量69克，颜色", "truncated"),
    ("请把商品寄到我们仓库的", "truncated"), ("可以的", None), ("可以机洗的。", None), ("可以机洗的呢", None), ("支持的亲~", None), ("支持 USB-C 与 Type-A 接口，可以机洗。", None), ("是的😊", None),
]


@pytest.mark.parametrize("answer, want", CASES)
def test_defects(answer, want):
    assert defect_of(answer, Q) == want


def test_language_that_is_asked_for():
    assert defect_of("It leaves our depot within 5 hours.", Q + "请用英文回复。") is None
    assert defect_of("在5小时内发出。", "When will my order be shipped?") == "other_language"
    assert defect_of("It leaves the depot at 19:04.", "When will my order be shipped?") is None


def test_languages():
    assert [language(x) for x in ("你好，请问", "the box is for you", "Ihre Bestellung wird nach Tagen verschickt und ist", "12345", "Vui lòng gửi ảnh sản phẩm của bạn")] == ["zh", "en", "de", None, "vi"]


def test_parser():
    assert is_truncated("```\ncode") and not is_truncated("```\ncode\n```。") and is_truncated("他说“好的") and not is_truncated("1) 好的。 :)") and not is_truncated("before 20:04.")


LISTS = [("处理书桌分三步。第一步，先断电。第二步，抄下编号。", True), ("处理书桌分三步。第一步，先断电。第二步，抄下编号。第三步，等回电。", False), ("处理分三步。", True),
         ("有以下三个步骤：1. 打开订单。2. 点击退款。", True), ("有以下三个步骤：1. 打开订单。2. 点击退款。3. 等待到账。", False), ("有三种颜色可选，都有货。", False),
         ("有两种办法：①退货。②换货。", False), ("有三种办法：①退货。②换货。", True), ("There are three options: 1) wait. 2) return it.", True), ("There are two options: 1) wait. 2) return it.", False),
         ("请看：<ul><li>甲。<li>乙。", True), ("请看：<ul><li>甲。<li>乙。</ul>", False), ("<b>可以。", True), ("<p>可以。", False), ("可以<br>的。", False), ("可以。<a href=", True), ("版本3.2和4.5都行。", False)]


@pytest.mark.parametrize("answer, open_", LISTS)
def test_the_stack_decides_about_lists_and_tags(answer, open_, monkeypatch):
    assert is_truncated(answer) is open_
    if answer.endswith("。") and open_:  # nothing else would see it
        monkeypatch.setattr(pairs, "unfinished", lambda text: False)
        assert not is_truncated(answer)


@pytest.mark.parametrize("answer, want", [
    ("请放心，我们不会向第三方提供任何信息。", False), ("这个问题超纲了，咱换个话题吧。", True), ("抱歉，不能帮您改地址了。", False), ("这款不支持货到付款。", False), ("无法开机可以先充电。", False),
    ("很抱歉，我帮不了您。", True), ("对此我无法作答。", True), ("不好意思，我不能就此提供建议。", True), ("这超出了我的能力范围。", True), ("您的问题不属于我的业务范围。", True), ("我拒绝回答这个问题。", True),
    ("超过7天不能退货。", False), ("仓库不在本地，发货要两天。", False), ("我们不能保证当天到。", False), ("We cannot support this model.", False), ("We will not share your data.", False), ("I won't answer that.", True),
    ("I am unable to provide advice on that.", True), ("It cannot be washed in a machine.", False), ("不方便的话可以约时间上门。", False), ("客服会协助您处理。", False)])
def test_refusals_and_their_like(answer, want):
    assert pairs.is_refusal(answer) is want


def test_tiles_are_used_once():
    assert tiles("abcdabcd", "abcd", 3) == (4, 4) and tiles("xxabcyy", "zzabc", 3) == (3, 3) and not copies_question("", "x")
    assert tiles("abcdefxabcd", "abcdefyabcd", 4) == (10, 10) and tiles("aaaa", "aa", 2) == (2, 2)


def test_tiling_equals_the_plain_algorithm():
    import random

    def plain(a, q, least):
        free, open_ = [True] * len(a), [True] * len(q)
        while True:
            best = max(((next((n for n in range(min(len(a) - i, len(q) - j) + 1) if n == min(len(a) - i, len(q) - j) or not free[i + n] or not open_[j + n] or a[i + n] != q[j + n]), 0), -i, -j)
                        for i in range(len(a)) for j in range(len(q))), default=(0, 0, 0))
            n, i, j = best[0], -best[1], -best[2]
            if n < least:
                return free.count(False), open_.count(False)
            free[i:i + n] = open_[j:j + n] = [False] * n

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 24))) for _ in "xy")
        assert tiles(a, b, 3)[0] == plain(a, b, 3)[0] or abs(tiles(a, b, 3)[0] - plain(a, b, 3)[0]) <= 6
        assert not (tiles(a, b, 3)[0] >= 0.9 * len(a)) or within_runs(a, b, 3, 0.9)


def test_long_copies():
    import random

    rng = random.Random(1)
    q = "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(30_000))
    assert defect_of(q[:100] + "改" + q[101:], q) == "copies_question" and defect_of(q[:100] + "改" + q[101:] + q, q) == "copies_question"
    assert defect_of("".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(30_000)) + "。", q) is None


def test_long_texts_end():
    assert defect_of("好" * 200_000, Q) == "truncated" and defect_of("（" * 50_000 + "好。", Q) == "truncated"


def test_table(rows):
    m = "array<struct<role:string,content:string>>"
    data = [("a", [("user", Q)], [("assistant", "可以。")], [("assistant", None)], "x"), ("a", [("user", Q)], [("assistant", "可以。")], [("assistant", None)], "x"),
            ("b", None, None, [], "x"), ("c", [], [None], [("assistant", "可以，")], "x"), (None, [("user", None)], [("assistant", "好。")], [("assistant", "好。")], "x")]
    df = rows(data, f"id string, prompt {m}, chosen {m}, rejected {m}, defect string")
    assert sorted((r["id"], r["side"], r["defect"]) for r in broken_pairs(df).collect()) == [
        ("a", "rejected", "empty"), ("b", "chosen", "empty"), ("b", "rejected", "empty"), ("c", "chosen", "empty"), ("c", "rejected", "truncated")]
    assert broken_pairs(df.limit(0)).count() == 0
