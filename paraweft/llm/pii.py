"""Personal data: spans by pattern, and terms around them that give the protected value away. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paraweft.llm.spread import spread_join
from paraweft.scratch import Scratch

#: Kinds in the order in which they are listed. Java patterns that find what the plain ones do: a possessive loop where
#: nothing after it could use what it gives back, and a start only where a run begins or the last match ended, so that a
#: run of any length is scanned once.
PATTERNS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
ADDED = ["remove", "generalise"]
TERM = r"[\p{L}\p{N}]++(?:['_-][\p{L}\p{N}]++)*+"

#: Code points on either side of a span in which terms are its context.
AROUND = 60
#: Shares of a value's information content from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Documents in which a term must stand beside a value.
SUPPORT = 2
#: Terms whose document frequencies are counted by a broadcast (some 50 bytes each); more are counted by shuffle.
BROADCAST_TERMS = 200_000
_RUN = 256


def prefix_sums(lens: Column) -> Column:
    """Sums of all elements before each one.

    Runs of 256 elements are summed apart, so appending to a growing array costs
    n * 256 + (n / 256)^2 steps and not n^2.
    """

    def fold(a: Column, start: Column) -> Column:
        zero = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, zero, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")), lambda acc: acc["out"])

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _RUN).cast("int")), lambda k: F.slice(lens, k * _RUN + 1, F.lit(_RUN)))
    heads = fold(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(runs, heads, lambda r, h: fold(r, h)))


def find(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of the matches, in code points: a text is its matches and the gaps that splitting at them leaves."""
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(got))
    lens = F.zip_with(gaps, got, lambda g, m: F.length(g) + F.length(m))
    ends = F.zip_with(prefix_sums(lens), lens, lambda s, n: s + n)
    return F.zip_with(ends, got, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))


def luhn(digits: Column) -> Column:
    """Whether digits pass: every second from the right is doubled, its digits summed, and all sum to a multiple of 10."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (F.pmod(F.length(digits) - i, F.lit(2)) + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


SPAN = "array<struct<start:int,nth:int,kind:string,end:int,value:string>>"


def base_spans(text: Column) -> Column:
    """All valid spans of the four kinds, by start, then kind as listed."""
    def of_kind(nth: int, kind: str, pattern: str) -> Column:
        valid = F.filter(find(text, pattern), lambda s: _valid(kind, s["value"]))
        spans = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
        held = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
        return F.when(held, spans).otherwise(F.array().cast(SPAN))

    found = [of_kind(nth, kind, pattern) for nth, (kind, pattern) in enumerate(PATTERNS)]
    return F.array_sort(F.concat(*found))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _windows(text: Column, spans: Column) -> Column:
    """For each span, up to AROUND code points on either side of it, not beyond the neighbouring spans; cut marks a side at which a word may be cut."""

    def sides(s: Column, i: Column) -> Column:
        left = F.greatest(s["start"] - AROUND, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), F.lit(0))
        right = F.least(s["end"] + AROUND, F.coalesce(F.get(spans, i + 1)["start"], F.length(text)))
        before = F.struct(left.alias("at"), F.substring(text, left + 1, F.greatest(s["start"] - left, F.lit(0))).alias("piece"), (left == s["start"] - AROUND).alias("cut_left"), F.lit(False).alias("cut_right"))
        after = F.struct(s["end"].alias("at"), F.substring(text, s["end"] + 1, F.greatest(right - s["end"], F.lit(0))).alias("piece"), F.lit(False).alias("cut_left"), (right == s["end"] + AROUND).alias("cut_right"))
        return F.struct(F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"), F.array(before, after).alias("sides"))

    return F.transform(spans, sides)


def _disclosing(found: DataFrame, docs_text: DataFrame, scratch: Scratch) -> DataFrame:
    """``(row, added)``: for each document, the terms around its spans that disclose them, by the corpus's co-occurrences."""
    sides = found.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.entity", F.explode("w.sides").alias("side")).select("row", "entity", "side.*")
    terms = sides.withColumn("terms", find(F.col("piece"), TERM)).select("row", "entity", "at", "cut_left", "cut_right", F.length("piece").alias("size"), F.explode("terms").alias("t"))
    terms = terms.where("not (cut_left and t.start = 0) and not (cut_right and t.end = size) and length(t.value) > 1")
    context = scratch.write(terms.select("row", "entity", F.lower("t.value").alias("term"), (F.col("at") + F.col("t.start")).alias("start"), (F.col("at") + F.col("t.end")).alias("end")), "context")

    both = context.groupBy("entity", "term", "row").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= SUPPORT)
    both = scratch.write(both, "both")
    entities = found.where(F.size("windows") > 0).select(F.explode(F.array_distinct(F.transform("windows", lambda w: w["entity"]))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    wanted = scratch.write(both.select("term").distinct(), "wanted")
    words = docs_text.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))).alias("term"))
    words = words.join(F.broadcast(wanted), "term", "left_semi") if wanted.count() <= BROADCAST_TERMS else spread_join(words, wanted, ["term"], scratch, "words")
    frequency = words.groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    total = found.count()
    judged = both.join(entities, "entity").join(frequency, "term")
    pmi = F.log2(F.lit(float(total)) * F.col("both") / (F.col("of_entity") * F.greatest("of_term", "both")))
    content = F.log2(F.lit(float(total)) / F.col("of_entity"))
    share = F.when(content > 0, pmi / content).otherwise(F.lit(0.0))
    judged = judged.withColumn("share", share).where(F.col("share") >= GENERALISE).select("entity", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("kind"))
    spans = spread_join(context, scratch.write(judged, "judged"), ["entity", "term"], scratch, "marked").groupBy("row", "start", "end").agg(F.max("kind").alias("kind"))
    nth = F.when(F.col("kind") == "remove", len(PATTERNS)).otherwise(len(PATTERNS) + 1)
    return spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", nth.alias("nth"), "kind", "end", F.lit("").alias("value")))).alias("added"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, base, added)``: spans of personal data in each document and of terms that disclose them.

    Base spans are emails, ip addresses (parts up to 255), cards (14 to 19 digits
    passing Luhn) and phones (10 to 15 digits), leftmost and non-overlapping per
    kind, start and end in code points.

    A base value, its letters made small, is a protected entity c. Terms are words
    of two or more characters within ``AROUND`` code points of a span, not beyond
    the neighbouring spans. Over all documents, with p the share of documents,
    PMI(c, t) = log p(c, t) / (p(c) p(t)), where c and t occur together if t is in
    c's context; IC(c) = -log p(c) is all there is to know of c. A term that
    stands beside c in ``SUPPORT`` documents or more and has PMI of at least
    ``REMOVE`` of IC is removed, from ``GENERALISE`` on generalised. Terms that are
    frequent elsewhere, or values that stand in every document, disclose nothing.

    ``key`` identifies the id and text. Rows that repeat count as often as they
    come in all statistics, and all get the spans. Null and empty texts have no spans. Other columns aren't read.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("text"))))
    base = rows.select("id", "text", key.alias("key"), base_spans(F.col("text")).alias("base"))
    windows = F.when(F.size("base") > 0, _windows(F.col("text"), F.col("base")))
    found = scratch.write(base.select(F.monotonically_increasing_id().alias("row"), "id", "key", "base", windows.alias("windows")), "found")
    added = _disclosing(found, rows, scratch)
    out = found.select("row", "id", "key", "base").join(added, "row", "left")
    return out.select(F.col("id").alias(id_col), "key", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the checksum of the base spans and the list of all spans of :func:`detect`'s result."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, _ in PATTERNS]
    return found.select(id_col, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)``: texts with base spans replaced by their kind, generalised terms by [word] or [number], and removed terms left out.

    Of spans that overlap, the first is replaced and what later ones have beyond it is replaced as well.
    A null text comes back as an empty one. Rows that repeat id and text come back once each.
    """
    found = detect(docs, id_col, text_col).select("key", "base", "added").dropDuplicates(["key"])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("text"))))
    out = rows.withColumn("key", key).join(found, "key").withColumn("all", F.array_sort(F.concat("base", "added")))

    def piece(s: Column, i: Column) -> Column:
        done = F.coalesce(F.array_max(F.transform(F.slice(F.col("all"), F.lit(1), i), lambda x: x["end"])), F.lit(0))
        gap = F.substring(F.col("text"), done + 1, F.greatest(s["start"] - done, F.lit(0)))
        value = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        shape = F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", F.when(value.rlike("^[0-9]+$"), "[number]").otherwise("[word]")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.concat(gap, F.when(s["end"] > done, shape).otherwise(""))

    last = F.coalesce(F.array_max(F.transform("all", lambda x: x["end"])), F.lit(0))
    text = F.concat(F.array_join(F.transform("all", piece), ""), F.substring(F.col("text"), last + 1, F.length("text")))
    return out.select(F.col("id").alias(id_col), text.alias(text_col))
