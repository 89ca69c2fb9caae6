"""Text cleaning, splitting and phrases as column expressions; no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Python sees it, written for Java and RE2 alike.
WS = r"[\s\x1C-\x1F\x{85}\p{Z}]"
NOT_WS = r"[^\s\x1C-\x1F\x{85}\p{Z}]"
#: Characters that end a sentence.
ENDINGS = {"zh": "。！？；：", "western": ".!?;:", "both": "。！？；：.!?;:"}
_PUNCTUATION = "。！？；：，、"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def clean(text: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def normalize(text: Column) -> Column:
    """Cleaned; no white space around full-width punctuation, but one space after a full stop, exclamation or question mark."""

    def tight(base: Column) -> Column:
        made = F.regexp_replace(base, f"{WS}*([{_PUNCTUATION}]){WS}*", "$1")
        return F.when(has_wide(base), F.regexp_replace(made, f"([。！？])({NOT_WS})", "$1 $2")).otherwise(base)

    return F.get(F.transform(F.array(clean(text)), tight), F.lit(0))


def has_wide(text: Column) -> Column:
    """Whether a full-width punctuation mark stands in the text."""
    return text.rlike(f"[{_PUNCTUATION}]")


def chinese_ratio(text: Column) -> Column:
    """Share of U+4E00..U+9FFF among characters that aren't white space; 0 without any."""
    visible = count(text, NOT_WS)
    return F.when(visible > 0, count(text, r"[\x{4E00}-\x{9FFF}]") / visible).otherwise(F.lit(0.0))


def normalize_chinese(text: Column) -> Column:
    """:func:`normalize`; mostly Chinese text also gets full-width punctuation and single spaces between scripts."""

    def widened(base: Column) -> Column:
        wide = F.translate(base, ",.!?:;", "，。！？：；")
        wide = F.regexp_replace(wide, rf"([\x{{4E00}}-\x{{9FFF}}]){WS}+([a-zA-Z])", "$1 $2")
        wide = F.regexp_replace(wide, rf"([a-zA-Z]){WS}+([\x{{4E00}}-\x{{9FFF}}])", "$1 $2")
        return F.when(chinese_ratio(base) > 0.5, wide).otherwise(base)

    return F.get(F.transform(F.array(normalize(text)), widened), F.lit(0))


def split_sentences(text: Column, endings: str = "zh") -> Column:
    """Sentences with their ending, stripped; those of 3 characters or fewer fall away. Null and blank texts have none."""
    e = ENDINGS[endings]
    parts = F.regexp_extract_all(F.coalesce(clean(text), F.lit("")), F.lit(f"[^{e}]*[{e}]|[^{e}]+$"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 3)


def split_chinese(text: Column) -> Column:
    """Sentences cut after each full stop, exclamation or question mark or semicolon; one shorter than 10 characters joins the sentence before it."""
    lined = F.regexp_replace(F.coalesce(text, F.lit("")), '([。！？；])(["])', "$1\n$2")
    lined = F.regexp_replace(lined, '(["])([。！？；])', "$1$2\n")
    parts = F.regexp_extract_all(lined, F.lit("[^。！？；]*[。！？；]|[^。！？；]+$"), F.lit(0))
    strip = f"^{WS}+|{WS}+$"
    parts = F.filter(F.transform(parts, lambda s: F.regexp_replace(s, strip, "")), lambda s: s != "")

    def step(acc: Column, s: Column) -> Column:
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), s)))
        return F.when((F.length(s) < 10) & (F.size(acc) > 0), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def sentences(text: Column, endings: str = "zh", zh_optimize: bool = False) -> Column:
    """The splitter that a text calls for: the Chinese one for mostly Chinese text if ``zh_optimize``."""
    plain = split_sentences(text, endings)
    return F.when(chinese_ratio(text) > 0.5, split_chinese(text)).otherwise(plain) if zh_optimize else plain


def is_valid(text: Column, max_length: int = 10_000) -> Column:
    """Whether a text is there, isn't blank and isn't too long."""
    return F.coalesce(text.rlike(NOT_WS) & (F.length(text) <= max_length), F.lit(False))


def key_phrases(text: Column, k: int = 3) -> Column:
    """The first ``k`` tokens of three or more letters, in order, repeats kept."""
    return F.slice(F.filter(F.split(text, f"{WS}+"), lambda w: w.rlike(r"^\p{L}{3,}$")), 1, k)


def joined(paragraphs: Column, separator: str = "\n\n") -> Column:
    """Paragraphs stripped, empty ones left out, joined."""
    strip = f"^{WS}+|{WS}+$"
    return F.array_join(F.filter(F.transform(paragraphs, lambda p: F.regexp_replace(p, strip, "")), lambda p: p != ""), separator)


def has_chinese(text: Column) -> Column:
    """Whether a character of U+4E00..U+9FFF stands in the text."""
    return text.rlike(r"[\x{4E00}-\x{9FFF}]")


def where_chinese(text: Column, number: Column) -> Column:
    """A count that is 0 for every text without such a character, and is not made for those."""
    return F.when(~has_chinese(text), F.lit(0)).otherwise(number)


def keywords_present(text: Column, words: list[str]) -> Column:
    """How many different words of the list stand in the text, case aside, as substrings."""
    words = [w.lower() for w in dict.fromkeys(words)]
    chinese = [w for w in words if any("\u4e00" <= c <= "\u9fff" for c in w)]
    other = [w for w in words if w not in chinese]

    def among(some: list[str]) -> Column:
        listed = F.array(*map(F.lit, some))
        return F.get(F.transform(F.array(F.lower(text)), lambda low: F.size(F.filter(listed, lambda w: F.contains(low, w)))), F.lit(0))

    if not chinese or not other:
        return where_chinese(text, among(words)) if chinese else among(words)
    return among(other) + where_chinese(text, among(chinese))
