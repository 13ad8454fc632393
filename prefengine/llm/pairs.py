"""Broken prompt and response pairs (problem 1).

Every side of a pair is read once and gets at most one defect, the first that applies:

``empty``            after thinking blocks, mark-up, entities and invisible characters nothing but a placeholder is left
``copies_question``  greedy string tiling covers the answer with runs of the question, and most of the question with it
``refusal``          a grammar over word classes (who, cannot, which act, what about) derives a clause of the answer
``other_language``   script counts, and function words among Latin-script languages, name another language than the
                     question's, which the question does not ask for
``truncated``        a pushdown automaton over fences, tags, brackets, quotations and announced lists does not end in a
                     final state, or the last sentence has no end (a mark, a modal tail, a farewell)

Defined results: a null or empty ``chosen``/``rejected`` array, a null message and null contents are ``empty``; a null
or empty prompt has no question, so only ``empty``, ``refusal`` and ``truncated`` can apply; the answer is the last
message of a side; a pair loaded twice gives one row per side; very long texts are read whole (the automaton is linear,
tiling too unless a text repeats itself); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefengine.llm._text import fold

_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_PLACEHOLDER = {"", "null", "none", "nan", "na", "nil", "undefined", "空", "无", "无内容", "空白", "无回复", "无答案", "暂无", "暂无内容", "empty", "todo", "tbd"}


def visible(answer: str) -> str:
    """The answer as a reader sees it: no thinking block, mark-up, entities or invisible characters."""
    text = _TAG.sub(" ", html.unescape(_THINK.sub("", answer)))
    if text.replace("\n", "").isprintable():  # no invisible character at all
        return text.strip()
    return "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t").strip()


def is_empty(seen: str) -> bool:
    return fold(seen) in _PLACEHOLDER and not any(unicodedata.category(c) == "So" and c != "\ufffd" for c in seen)


# --- copies of the question -----------------------------------------------------------------------------------------

#: What may stand around a given-back question without being an answer.
_FRAME = re.compile(r"您问的是|你问的是|您的问题是|您想问的是|您问|问题|提问|亲亲|您好|你好|亲|question|youasked|yourquestionis|yourquestion")


def tiles(answer: str, question: str, least: int, free: bytearray | None = None) -> tuple[int, int]:
    """Greedy string tiling: characters of the answer and of the question newly covered by common runs of ``least`` or more.

    The longest runs are marked first and no mark is used twice.  Run lengths are searched from long to short by a table
    of the question's unmarked windows, as with running hashes.  ``free`` holds the answer's unmarked characters.
    """
    free = bytearray(b"\1") * len(answer) if free is None else free
    open_ = bytearray(b"\1") * len(question)
    before, size = free.count(0), max(least, min(len(answer), len(question), 32))
    while True:
        windows: dict[str, list[int]] = {}
        for j in _starts(open_, size):
            windows.setdefault(question[j:j + size], []).append(j)
        found = []
        for i in _starts(free, size) if windows else ():
            for j in windows.get(answer[i:i + size], ()):
                if i and j and free[i - 1] and open_[j - 1] and answer[i - 1] == question[j - 1]:
                    continue  # within a run that began before
                n = size
                while i + n < len(answer) and j + n < len(question) and free[i + n] and open_[j + n] and answer[i + n] == question[j + n]:
                    n += 1
                found.append((-n, i, j))
        for n, i, j in sorted(found):
            if 0 not in free[i:i - n] and 0 not in open_[j:j - n]:
                free[i:i - n] = open_[j:j - n] = bytes(-n)
        if not found:
            if size == least:
                return free.count(0) - before, open_.count(0)
            size = max(least, size // 2)


def _starts(free: bytearray, size: int) -> list[int]:
    """Where ``size`` unmarked characters begin."""
    out, run = [], 0
    for i, x in enumerate(free):
        run = run + 1 if x else 0
        if run >= size:
            out.append(i - size + 1)
    return out


def within_runs(answer: str, question: str, least: int, share: float) -> bool:
    """Whether ``share`` of the answer lies in common runs of ``least`` or more; without that no tiling covers so much."""
    known = {question[i:i + least] for i in range(len(question) - least + 1)}
    out, end, most = 0, 0, (1 - share) * len(answer) + 1e-9
    for i in range(len(answer) - least + 1):
        if answer[i:i + least] in known:
            out += max(0, i - end)
            end = i + least
        if out + max(0, i - end) > most:
            return False
    return out + len(answer) - end <= most


def copies_question(answer: str, question: str) -> bool:
    a = fold(answer).replace("您", "我").replace("你", "我")
    q = fold(question).replace("您", "我").replace("你", "我")
    if not q or not a:
        return False
    if a == q:
        return True
    a = _FRAME_FOLDED.sub("", a)
    q = _FRAME_FOLDED.sub("", q)
    if not q or not a or len(q) > 4 * len(a):
        return False
    if q in a and len(a) <= len(q) + 2:
        return True
    least = min(4, len(a))
    if not within_runs(a, q, least, 0.9):
        return False
    free, met = bytearray(b"\1") * len(a), 0
    while True:  # a question given back several times is tiled as often
        new, own = tiles(a, q, least, free)
        met = max(met, own)
        if not new:
            return free.count(0) >= 0.9 * len(a) and met >= 0.8 * len(q)


_FRAME_FOLDED = re.compile(_FRAME.pattern.replace("您", "我").replace("你问", "我问").replace("你好", "我好"))

# --- refusals -------------------------------------------------------------------------------------------------------

#: Word classes of the grammar of refusals, longest words first within the reading order.
_CLASSES = (
    ("B", "(?:回答|解答|答复|作答|答|帮|协助|帮助|帮忙)(?:不了|不到|不上)|答不上来|爱莫能助|无能为力"),
    ("D", "无可奉告|恕不奉陪|恕不(?:回答|作答|答复|奉告)|恕难(?:回答|作答|从命|奉告|答复)|不予(?:回答|作答|置评|答复|回应)"),
    ("C", "换(?:个|一个)(?:话题|问题)|聊(?:点|些)(?:别的|其他)|(?:咨询|问|找|去)(?:一下)?(?:别处|别家|别人|他处)|另请高明|另寻他处"),
    ("X", "超纲|超出(?:了)?|超过(?:了)?|不在|不属于|不归"),
    ("R", "拒绝"),
    ("N", "恕(?:我|本店|小店|在下)?(?:不能|无法|不便|难以|不)|无法|不能(?:够)?|没办法|没有办法|没法|不方便|不便|难以|无权|没有权限|不被允许|不允许|不可以"),
    ("W", "不会|不愿意?|不想|不打算"),
    ("A", "回答|作答|答复|解答|回应|置评|奉告|从命|效劳|讨论|谈论|评论|评价|透露"),
    ("H", "协助|帮助|帮忙|帮|满足|处理|提供|给出|继续|支持"),
    ("I", "(?:任何|相关|此类|这类|具体)?(?:建议|意见|答案|解答|回答|答复|帮助|协助)"),
    ("Q", "(?:您|你)(?:所)?(?:说|问|提)(?:到|及|起)?的(?:问题|事情|事)?|(?:您|你|亲)?的?(?:这个|该|此|这|这类|此类|那个|关于[^，,。]{1,12}的)(?:类)?(?:方面)?的?(?:问题|请求|要求|话题|内容|提问|咨询)|(?:您|你)的(?:问题|请求|要求|提问)|就此|对此|此事|(?:相关|有关|方面)的?(?:内容|话题|问题|事情|事)"),
    ("G", "(?:的)?(?:能力|服务|权限|知识|职责|业务|回答|解答|工作)?(?:范围|范畴)(?:之内|以内|内)?|(?:的)?(?:能力|权限|职责)"),
    ("O", "第三方|他人|别人|外界|任何人|外部"),
    ("S", "我们|我|咱们|咱|本助手|本店|小店|这边|客服"),
    ("Y", "您|你|亲"),
    ("M", "一个?(?:智能)?(?:客服)?(?:助手|模型|机器人)|人工智能|语言模型|AI|(?:智能|客服)?(?:助手|机器人)"),
    ("e", "[呢哦哈啊呀吧啦了的～~、 ]+|非常|很|真的|实在|暂时|目前|也|都|就|是|到|给|为|向|对|这里|作为|只是|一名|一款|一位|抱歉|不好意思|对不起|请"),
)
#: A clause without any of these classes is derived by no rule.
_HINT = re.compile("|".join(words for name, words in _CLASSES if name in "BDCXRNW"))
_CLASS = re.compile("|".join(f"(?P<{name}>{words})" for name, words in _CLASSES) + "|(?P<u>.)", re.S)
#: What the grammar derives: clauses as class letters, without the empty words e; u is any other text.
_DERIVED = re.compile("|".join((
    "[SMY]?N[SYQu]{0,3}A(?:[uS]{0,3}[QYI]|$|u{0,4}$)",  # cannot ... answer (this, you, nothing)
    "Nu{0,2}[SYQ]*H[YQ]*(?:A|H)?(?:I|Q|$)",  # cannot help (you) (deal with) this; cannot give advice
    "(?:N|W)[SY]?(?:Q)[SY]?(?:A|H)",  # cannot on this matter answer
    "W[SY]*A(?:[QYI]|$)", "N[SYQ]*I$", "B(?:[YQ]|$)", "D", "C",
    "R(?:A|Q|H?I)", "[SQM]?X[SM]?u?G", "QX$", "QX[SM]?",
)))
_MODEL = re.compile(next(words for name, words in _CLASSES if name == "M"))
_ENGLISH = re.compile("|".join((
    r"\b(?:i|we)(?:'m| am|'re| are)?[^.!?]{0,24}\b(?:can't|cannot|can not|unable to|not able to|won't be able to|not allowed to|not permitted to|must decline|have to decline|decline)\b"
    r"[^.!?]{0,20}\b(?:help|assist|answer|discuss|respond|comply|talk about|comment|advise|(?:provide|give|offer)[^.!?]{0,16}(?:answer|advice|help|assistance|information on (?:that|this))|(?:that|this) (?:request|question|topic))",
    r"\b(?:i|we) (?:won't|will not)\b[^.!?]{0,16}\b(?:answer|discuss|respond|comply|comment|talk about)\b",
    r"\bbeyond what (?:i|we)\b|\bnot something (?:i|we) (?:can|am able|are able)|\bi (?:must|have to) (?:decline|refuse)|\boutside (?:of )?(?:my|our) (?:scope|remit|abilities)",
    r"\bas an? (?:ai|language model|virtual assistant|assistant)\b[^.!?]{0,60}(?:can't|cannot|unable|not able)",
)), re.I)
_LATIN = re.compile("[A-Za-z]{2} [A-Za-z]")
_CLAUSE = re.compile("[。！？!?；;\n，,]")


def classes(clause: str) -> str:
    """A clause as the letters of its word classes; runs of other text are one u, empty words are left out."""
    out = "".join(m.lastgroup for m in _CLASS.finditer(clause))
    return re.sub("u+", "u", out.replace("e", ""))


def is_refusal(seen: str) -> bool:
    """Whether the grammar derives a clause; whatever is kept from other parties is no refusal."""
    text = seen.replace("’", "'")
    if _LATIN.search(text) and _ENGLISH.search(text):
        return True
    model = False
    for clause in _CLAUSE.split(text):
        form = classes(clause) if clause and (_HINT.search(clause) or _MODEL.search(clause)) else ""
        if form and "O" not in form and (_DERIVED.search(form) or model and re.search("^[SM]?N[SYQ]*[AHI]", form)):
            return True
        model = model or "M" in form  # I am but a model: what it cannot do next is what was asked
    return False


# --- languages ------------------------------------------------------------------------------------------------------

_SCRIPTS = (("ja", re.compile("[\u3041-\u30ff\u31f0-\u31ff]")), ("ko", re.compile("[\uac00-\ud7a3\u1100-\u11ff]")),
            ("ru", re.compile("[\u0400-\u04ff]")), ("ar", re.compile("[\u0600-\u06ff]")), ("th", re.compile("[\u0e00-\u0e7f]")),
            ("el", re.compile("[\u0370-\u03ff]")), ("he", re.compile("[\u0590-\u05ff]")), ("hi", re.compile("[\u0900-\u097f]")))
_OTHER = re.compile("|".join(script.pattern for _, script in _SCRIPTS))
_HAN = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_WORD = re.compile("[a-zà-öø-ÿœ\u0100-\u024f\u1e00-\u1eff]+(?:['’][a-zà-öø-ÿ]+)?")
#: Frequent function words of Latin-script languages.
_FUNCTION_WORDS = {
    "en": "the a an and or of to in is are was for with you your we our it this that will can not on at from have has be if please do does i my by as after before when how what which".split(),
    "fr": "le la les un une des du de et est sont dans pour avec vous votre vos nous notre que qui sur sous pas ne en au aux sera dès merci jours commande cours ce cette l d".split(),
    "de": "der die das ein eine und ist sind für mit sie ihr ihre ihren wir unser nicht auf zu von den dem in wird werden nach vielen dank tage tagen bitte bestellung es im am".split(),
    "es": "el la los las un una y es son en para con usted su sus nosotros nuestro que por no se de del al será gracias días pedido lo está".split(),
    "pt": "o a os as um uma e é são em para com você seu sua nós nosso que por não se de do da ao será obrigado dias pedido está".split(),
    "vi": "vui lòng gửi và của là được sẽ không cho trong với bạn chúng tôi đơn hàng sản phẩm thời gian cảm ơn có để này".split(),
    "nl": "de het een en van is zijn voor met u uw wij ons niet op naar binnen dagen bedankt bestelling wordt dank".split(),
    "pl": "i w na z do nie się jest za po dni zamówienie dziękujemy zostanie państwa prosimy".split(),
    "tr": "ve bir bu için ile gün içinde siparişiniz teşekkür ederiz lütfen olarak".split(),
    "id": "dan yang di untuk dengan anda kami akan pesanan hari dalam terima kasih tidak".split(),
    "it": "il lo la i gli le un una e è sono in per con lei suo sua noi nostro che non si di del della al sarà grazie giorni ordine è".split(),
}
_WORDS = {lang: frozenset(words) for lang, words in _FUNCTION_WORDS.items()}
#: How a question names the language it wants.
_NAMES = {"en": "英文|英语|english", "zh": "中文|汉语|普通话|chinese|mandarin", "ja": "日文|日语|japanese", "ko": "韩文|韩语|korean",
          "fr": "法文|法语|french", "de": "德文|德语|german", "es": "西班牙文|西班牙语|spanish", "ru": "俄文|俄语|russian",
          "pt": "葡萄牙文|葡萄牙语|portuguese", "it": "意大利文|意大利语|italian"}
_ASKED = {lang: re.compile(f"(?:{names})", re.I) for lang, names in _NAMES.items()}


@lru_cache(maxsize=64)  # both sides of a pair have one question
def language(text: str) -> str | None:
    """The language a text is mostly in, or None where nothing tells."""
    han = len(_HAN.findall(text))
    for lang, script in _SCRIPTS if _OTHER.search(text) else ():
        n = len(script.findall(text))
        if n >= 3 and n >= (0.15 if lang == "ja" else 0.5) * han:
            latin = sum(map(len, _WORD.findall(text.lower())))
            if lang == "ja" or n >= 0.3 * latin:
                return lang
    words = _WORD.findall(re.sub(r"[A-Za-z]*\d[A-Za-z0-9]*", " ", text).lower())
    if not words:
        return "zh" if han else None
    votes = {lang: sum(w in known for w in words) for lang, known in _WORDS.items()}
    best = max(votes, key=lambda lang: (votes[lang], lang == "en"))
    # a sentence of another language may name a thing in ideographs
    if han and 2.5 * han >= len(words) and not (votes[best] >= 3 and votes[best] >= 0.25 * len(words) and han <= len(words)):
        return "zh"
    if votes[best] >= max(2, 0.12 * len(words)):
        return best
    return "latin" if len(words) >= 4 else None


def other_language(seen: str, question: str) -> bool:
    told, asked = language(seen), language(question)
    if told is None or asked is None or told == asked:
        return False
    if told == "latin" and asked not in ("zh", "ja", "ko", "ru", "ar", "th"):
        return False
    if asked == "latin" and told != "zh":
        return False
    wants = _ASKED.get(told)
    return not (wants and wants.search(question))


# --- truncation -----------------------------------------------------------------------------------------------------

_OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "{": "}", "《": "》", "“": "”", "‘": "’", "「": "」", "『": "』"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_SAME = {"(": "（", "[": "【"}
_FINAL = set("。.！!？?~～")
#: What ends a sentence that has no mark: modal tails, farewells, and 的/了 after a short predicate.
_TAIL = re.compile("(?:呢|哈|哦|亲|谢谢|谢谢您|感谢|啦|哟|呀|嘛|喔|噢|哒|么么|thanks|thank you|bye)$|(?:^|[，,。！!；;\\s])[^，,。！!；;\\s]{1,4}[的了]$", re.I)
#: Elements without a closing tag, and those whose closing tag may be left out.
_NO_CLOSING = frozenset("br hr img input meta link wbr col p li td th tr dt dd option".split())
#: How many parts a list announces.
_NUMBERS = {"一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10,
            "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
_MARKER = re.compile(r"(?:^|\n|[；;：]|(?<!\d):)\s*(?:\d{1,2}[.、．)）]|[-*•·]|[（(]\d{1,2}[)）]|第?[一二三四五六七八九十]+[、.])\s*$")
_SYMBOL = re.compile("|".join((
    "(?P<fence>```)",
    r"(?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>)",
    r"(?P<announced>(?:(?P<steps>分|按|共|有|以下|如下|下列|下面)[^。！？\n]{0,4})(?P<count>[两二三四五六七八九十]|(?<!\d)[2-9])(?:大|个|种|点|项|步|条|类|方面|样)(?P<noun>步骤|方案|办法|方法|选择|原因|事项|注意|要求|情况|途径|渠道|做法|建议|步)?(?P<colon>[^。！？：:，,]{0,6}[：:])?"
    r"|\b(?P<word>two|three|four|five|six|(?<!\d)[2-9]) (?:steps|options|ways|reasons|points|things|methods)\b[^.!?:\n]{0,12}(?P<ecolon>:)?)",
    r"(?P<item>(?:(?<![\d.])(?P<digit>\d{1,2})(?:[.．](?!\d)|[、)）])|[（(](?P<paren>\d{1,2})[)）]|(?P<ring>[①-⑳])|(?:第|方案|步骤|其|选项)(?P<han>[一二三四五六七八九十])(?:步|点|种|项|个|条)?|(?P<hand>[一二三四五六七八九十])(?:、|是(?=[^否])))|(?:(?<=\n)|^)\s*(?P<bullet>[-*•·])\s)",
    "(?P<mark>[()（）\\[\\]【】{}《》“”‘’「」『』\"\n])",
)))
_ITEM_START = set("\n：:；;。，,. 　！!？?>")


def unfinished(text: str) -> bool:
    """Whether the pushdown automaton ends with something open: a fence, tag, bracket, quotation or announced list."""
    stack: list[list] = []  # [kind, symbol, announced, seen]

    def top(kind: str) -> int:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == kind), -1)

    for m in _SYMBOL.finditer(text):
        kind = m.lastgroup if m.lastgroup in ("fence", "tag", "mark") else "announced" if m["announced"] else "item"
        if m["fence"]:
            at = top("fence")
            if at >= 0:
                del stack[at:]
            else:
                stack.append(["fence", "```"])
        elif top("fence") >= 0:
            continue
        elif m["tag"]:
            name = re.match("</?([A-Za-z0-9]+)", m["tag"])[1].lower()
            if m["tag"].startswith("</"):
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][:2] == ["tag", name]), -1)
                if at >= 0:
                    del stack[at:]
            elif not m["tag"].endswith("/>") and name not in _NO_CLOSING:
                stack.append(["tag", name])
            elif name == "li" and (at := top("list")) >= 0:
                stack[at][3] += 1
        elif kind == "announced":
            count = m["count"] or m["word"]
            n = int(count) if count.isdigit() else _NUMBERS[count.lower()]
            # without a colon only steps are sure to follow
            if n > 1 and (m["colon"] or m["ecolon"] or m["steps"] == "分" and "步" in m[0]):
                stack.append(["list", m[0], n, 0])
        elif kind == "item":
            at = top("list")
            if at < 0 or m.start() and text[m.start() - 1] not in _ITEM_START:
                continue
            number = m["digit"] or m["paren"]
            k = (int(number) if number else ord(m["ring"]) - 0x245f if m["ring"] else _NUMBERS[m["han"] or m["hand"]] if m["han"] or m["hand"] else stack[at][3] + 1)
            if k <= stack[at][2]:
                stack[at][3] = max(stack[at][3], k)
            if m[0][0] in "（(" or m[0][-1] in ")）":
                continue
        else:
            c = m["mark"]
            if c in _OPEN:
                stack.append(["open", c])
            elif c in _CLOSE:
                for at in range(len(stack) - 1, -1, -1):  # a stray closer (1), :) pops nothing
                    if stack[at][0] == "open" and (stack[at][1] == _CLOSE[c] or _SAME.get(stack[at][1]) == _CLOSE[c] or _SAME.get(_CLOSE[c]) == stack[at][1]):
                        del stack[at]
                        break
            elif c == '"':
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] == ["open", '"']), -1)
                if at >= 0:
                    del stack[at]
                else:
                    stack.append(["open", c])
            elif c == "\n" and stack and stack[-1][0] == "open" and stack[-1][1] in "‘\"":
                stack.pop()  # an apostrophe or an inch
    for entry in stack:
        if entry[0] in ("fence", "tag") or entry[0] == "list" and entry[3] < entry[2] and (entry[3] or "步" in entry[1]):
            return True
        if entry[0] == "open" and entry[1] in "(（[【{《“「『" and text[-1] not in ")）":
            return True
    return bool(re.search("<[A-Za-z/][^<>]{0,200}$", text)) or text.endswith("\ufffd") or _MARKER.search(text) is not None


def is_truncated(answer: str) -> bool:
    """Whether something is left open, or the last sentence has no end."""
    text = html.unescape(_THINK.sub("", answer))
    if not text.replace("\n", "").isprintable():
        text = "".join(c for c in text if unicodedata.category(c) != "Cf" or c == "\u200d")
    text = text.rstrip()
    if not text:
        return False
    if unfinished(text):
        return True
    text = _TAG.sub(" ", text).rstrip()
    if not text:
        return False
    last = text[-1]
    if last in _FINAL or last in _CLOSE or last in "\"`":
        return False
    if unicodedata.category(last) in ("So", "Sk", "Mn", "Me") or last in "^_>❤♥":
        return False
    return _TAIL.search(text) is None


# --- the operator ---------------------------------------------------------------------------------------------------

def defect_of(answer: str | None, question: str | None) -> str | None:
    """The defect of one answer to one question, or None."""
    if answer is None:
        return "empty"
    seen = visible(answer)
    if is_empty(seen):
        return "empty"
    question = question or ""
    if copies_question(seen, question):
        return "copies_question"
    if is_refusal(seen):
        return "refusal"
    if question and other_language(seen, question):
        return "other_language"
    return "truncated" if is_truncated(answer) else None


def broken_pairs(pairs: DataFrame, record: str = "id") -> DataFrame:
    """(id, side, defect) of every defective side; one small row per side reaches Python and only defects come back."""
    last = lambda c: F.try_element_at(F.col(c), F.lit(-1))["content"]
    sides = pairs.select(F.col(record).alias("id"), last("prompt").alias("question"),
                         last("chosen").alias("chosen"), last("rejected").alias("rejected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, side, defect)
                    for i, q, chosen, rejected in zip(*(c.to_pylist() for c in b.columns), strict=True)
                    for side, answer in (("chosen", chosen), ("rejected", rejected))
                    if (defect := defect_of(answer, q))]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["id", "side", "defect"])

    return sides.mapInArrow(run, "id string, side string, defect string").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(spark.read.parquet(f"{sf_dir}/dpo_pairs.parquet"))
