"""Text scalars as Catalyst expressions; only Unicode composition and entity decoding need a (vectorised) Python step.

Java classes are ASCII-only by default, so every pattern that means Unicode says ``(?U)``.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values of the cleaning rules ------------------------------------------------------------------------------
#: Marks mapped one to one after NFKC (an ellipsis becomes three dots and is collapsed like any repeated mark).
MARKS_FROM = "“”‘’（）【】｛｝《》—－–·•￥／＼　"
MARKS_TO = "\"\"''()[]{}<>---  ¥/\\ "
EMOJI = ("[\\x{1F300}-\\x{1F5FF}\\x{1F600}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F700}-\\x{1F77F}\\x{1F780}-\\x{1F7FF}"
         "\\x{1F800}-\\x{1F8FF}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FA6F}\\x{1FA70}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}]+")
ZERO_WIDTH = "[\\x{200B}-\\x{200F}\\x{FEFF}]"
CONTROL = "[\\x{0}-\\x{8}\\x{B}-\\x{1F}\\x{7F}-\\x{9F}]"
REPEATED = "([,，.。!！?？~～:：;；、])\\1+"
SPACED = "(?U)\\s*([,，.。!！?？:：;；、])\\s*"
NORM_CLASS = "[，,。.!！?？:：;；、/\\\\|()\\[\\]{}\"'`~\\-]+"
YEAR_MONTH_DAY = "(?U)(?<!\\d)(20\\d{2})\\s*[-/.年]\\s*(\\d{1,2})\\s*[-/.月]\\s*(\\d{1,2})\\s*日?(?!\\d)"
MONTH_DAY = "(?U)(?<!\\d)(\\d{1,2})\\s*[-/.月]\\s*(\\d{1,2})\\s*日(?!\\d)"
COLON_TIME = "(?U)(?<!\\d)(\\d{1,2})\\s*[:：]\\s*(\\d{1,2})(?!\\d)"
CLOCK_TIME = "(?U)(?<!\\d)(\\d{1,2})\\s*点\\s*(\\d{1,2})?\\s*分?(?!\\d)"
LOW_VALUE_QUESTIONS = ("在吗", "在不在", "有人吗", "你好", "您好", "好的", "好", "嗯", "哦", "收到")
LOW_VALUE_ANSWERS = ("好的", "好", "嗯", "哦", "亲", "亲亲", "您好", "你好", "在的", "在呢", "稍等", "稍等哈", "请稍等", "不客气", "谢谢")

_EDGE = "(?U)^[\\s,，.。!！?？~～:：;；、/\\\\|]+|[\\s,，.。!！?？~～:：;；、/\\\\|]+$"
_MARK, _STOP = "\ue000", "\ue001"  # private-use characters: a pending zero, and the end of a number


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Entities decoded and NFKC; null gives ''."""
    return texts.map(lambda t: "" if t is None else t if t.isascii() and "&" not in t else unicodedata.normalize("NFKC", html.unescape(t)))


def safe_text(c: Column) -> Column:
    """Null gives '', anything else its string (a NaN number: see ``safe_number``)."""
    return F.coalesce(c.cast("string"), F.lit(""))


def safe_number(c: Column) -> Column:
    """Null and NaN give '', any other number its string."""
    return F.when(c.isNull() | F.isnan(c), F.lit("")).otherwise(c.cast("string"))


def strip(c: Column) -> Column:
    """Trims Unicode blanks on both sides."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of Unicode blanks become one space, outer ones go."""
    return strip(F.regexp_replace(c, "(?U)\\s+", " "))


def _padded(c: Column, pattern: str, replacement: str) -> Column:
    """Replaces ``pattern`` by ``replacement``, in which <1>, <2>, <3> are groups padded to two digits.

    regexp_replace can't format a group, so a pending zero is put before each number and dropped again where the number
    has two digits.
    """
    for i in "123":
        replacement = replacement.replace(f"<{i}>", f"{_MARK}0${i}{_STOP}")
    c = F.regexp_replace(c, pattern, replacement)
    c = F.regexp_replace(c, f"{_MARK}0{_STOP}", "00")
    c = F.regexp_replace(c, f"(?U){_MARK}0(\\d\\d){_STOP}", "$1")
    return F.regexp_replace(c, f"[{_MARK}{_STOP}]", "")


def iso_dates(c: Column) -> Column:
    """20dd-m-d in any of its spellings as YYYY-MM-DD."""
    return _padded(c, YEAR_MONTH_DAY, "$1-<2>-<3>")


def month_days(c: Column) -> Column:
    """m月d日 as MM-DD; a range such as 3-5日 reads as a date, too."""
    return _padded(c, MONTH_DAY, "<1>-<2>")


def colon_times(c: Column) -> Column:
    """h:m as HH:MM, whatever the numbers."""
    return _padded(c, COLON_TIME, "<1>:<2>")


def clock_times(c: Column) -> Column:
    """h点 and h点m分 as HH:MM."""
    return _padded(c, CLOCK_TIME, "<1>:<2>")


def plain_numbers(c: Column) -> Column:
    """Commas between groups of three digits go."""
    return F.regexp_replace(c, "(?<=(?<!\\d)\\d{1,3}(?:,\\d{3}){0,12}),(?=\\d{3}(?:,\\d{3})*(?!\\d))", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, " ")


def strip_invisible(c: Column) -> Column:
    """Zero-width characters go; controls and broken characters become a space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, ZERO_WIDTH, ""), CONTROL, " "), "\\x{FFFD}+", " ")


def tidy_marks(c: Column) -> Column:
    """Repeated marks collapse, blanks around them go, a space follows 。！？."""
    c = F.regexp_replace(F.regexp_replace(c, REPEATED, "$1"), SPACED, "$1")
    return F.regexp_replace(c, "(?U)([。！？])(\\S)", "$1 $2")


def clean_text(c: Column, keep_titles: bool = False) -> Column:
    """The whole cleaning chain, in its fixed order.

    《…》 is read as a tag and lost, as the rules have it; ``keep_titles`` keeps such titles.
    """
    source, target = MARKS_FROM, MARKS_TO
    if keep_titles:
        source, target = "".join(a for a in source if a not in "《》"), "".join(b for a, b in zip(source, target, strict=True) if a not in "《》")
    c = F.replace(F.translate(composed(c.cast("string")), source, target), F.lit("…"), F.lit("..."))
    c = strip_invisible(strip_emoji(strip_tags(c)))
    c = plain_numbers(clock_times(colon_times(month_days(iso_dates(c)))))
    c = F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return collapse(tidy_marks(collapse(c)))


def strip_edges(c: Column) -> Column:
    """Blanks and marks go on both sides."""
    return F.regexp_replace(c, _EDGE, "")


def squeezed(c: Column) -> Column:
    """Lower case without edge marks, blanks and marks: the comparison key of a text that is clean already."""
    low = F.lower(c)  # the wide tilde is the only edge mark that stays within a text
    return F.regexp_replace(F.when(F.contains(low, F.lit("～")), strip_edges(low)).otherwise(low), "(?U)[\\s" + NORM_CLASS[1:], "")


def dedup_key(c: Column) -> Column:
    """The comparison key of any text: cleaned, then squeezed."""
    return squeezed(clean_text(c))


def low_value(c: Column, least: int, stop: tuple[str, ...]) -> Column:
    """Whether nothing but marks, a stop phrase or fewer than ``least`` characters are left."""
    core = strip_edges(F.coalesce(c, F.lit("")))
    far = max([least, *map(len, stop)])  # two letters or digits with so many characters between are in the core, which settles it
    return ~F.coalesce(c, F.lit("")).rlike(rf"(?s)[\p{{L}}\p{{Nd}}].{{{far},}}?[\p{{L}}\p{{Nd}}]") & ((F.length(core) < max(1, least)) | core.isin(*stop) | core.rlike("(?U)^[\\W_]+$"))


def low_value_question(c: Column, least: int = 2) -> Column:
    return low_value(c, least, LOW_VALUE_QUESTIONS)


def low_value_answer(c: Column, least: int = 4) -> Column:
    return low_value(c, least, LOW_VALUE_ANSWERS)


def strip_thinking(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?s)<think>.*?</think>", ""))


def occurrences(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def digit_runs(c: Column, most: int = 3) -> Column:
    return F.least(F.regexp_count(c, F.lit("(?U)\\d+")), F.lit(most))


def contains_any(c: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Whether any term occurs; one compiled alternation, which stays in generated code."""
    if not terms:
        return F.lit(False)
    return c.rlike("|".join(re.escape(t) for t in terms))


def terms_in(c: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """The terms that occur, in list order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t))


def length_bucket(c: Column, step: int, most: int) -> Column:
    return F.least((F.length(c) / step).cast("int") * step, F.lit(most))


def messages_text(messages: Column) -> Column:
    """'1. role: content' lines."""
    return F.array_join(F.transform(messages, lambda m, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def candidates_text(candidates: Column) -> Column:
    """A header with index and sampling settings before each candidate."""
    return F.array_join(F.transform(candidates, lambda c: F.concat(
        F.lit("[candidate "), c["index"].cast("string"), F.lit("] temperature="), c["temperature"].cast("string"),
        F.lit(", top_p="), c["top_p"].cast("string"), F.lit("\n"), c["content"])), "\n\n")


def filled(template: str, **values: Column) -> Column:
    """A prompt template with its {names} filled in."""
    out: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def target_length(c: Column) -> Column:
    """How long a rewrite of a text may get."""
    n = F.length(c)
    return F.least(F.lit(220), F.greatest(n + 80, F.floor(n * F.lit(22) / 10)))


def run_tag(c: Column) -> Column:
    return F.replace(c.cast("string"), F.lit("."), F.lit("p"))


def cache_key(**parts: Column) -> Column:
    """SHA-256 of the sorted-key JSON object of the parts."""
    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")),
                                                        F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    body = [x for i, k in enumerate(sorted(parts)) for x in (F.lit(f'{", " if i else ""}"{k}": '), quoted(parts[k]))]
    return F.sha2(F.concat(F.lit("{"), *body, F.lit("}")), 256)


def lenient_json(c: Column) -> Column:
    """A model's answer as VARIANT: fences go; where that is no JSON, what stands from the first { to the last }."""
    bare = strip(F.regexp_replace(strip(c), "(?i)^```(?:json)?\\s*|\\s*```$", ""))
    first = F.instr(bare, "{")
    inner = F.regexp_extract(bare, "(?s)\\{.*\\}", 0)
    return F.coalesce(F.try_parse_json(bare), F.when(first > 0, F.try_parse_json(inner)))
