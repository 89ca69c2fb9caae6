"""Mixing sources to target weights: hash order, distributed prefix sums and an exact cut. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from paraweft.scratch import Scratch

#: Sources up to which their plan (some 100 bytes each) is broadcast; beyond it is joined by shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of a key by which a source is summed at each step; what is left after them is summed key by key.
STEPS = (3, 3, 3)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Adds: grp, a non-null name of the source; size in words; key, the hash that orders a source."""
    source = F.col(source_col).cast("string")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"\x01grp": F.coalesce(F.concat(F.lit("s"), source), F.lit("n")), "\x01size": size, "\x01key": key})


def targets(sizes: DataFrame, weights: tuple[int, ...], ratio: float, epochs: int) -> DataFrame:
    """``(grp, total)`` to words due to each source.

    Sources in the order of their names' code points, null last, have the
    weights in turn. A source's share stops at ``epochs`` times its size and the
    excess is reshared by weight. Taking sources by ascending size over weight,
    the level (words for each unit of weight) that results if all before one are
    stopped is largest at the first that is not stopped, so the largest is the level.
    """
    by_name = Window.orderBy(F.substring("grp", 1, 1).desc(), F.col("grp"))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long"))
    by_need = Window.orderBy(F.col("total") / F.col("weight"), "grp")
    everything = Window.partitionBy()
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(ratio) * F.sum("total").over(everything) - F.lit(epochs) * F.coalesce(F.sum("total").over(before), F.lit(0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return ranked.select("grp", "total", F.least(F.lit(float(epochs)) * F.col("total"), F.col("weight") * F.col("level")).alias("target"))


def _few(rows: DataFrame) -> DataFrame:
    """Rows of which there is one a source: broadcast up to ``BROADCAST_SOURCES``."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_SOURCES else rows


def cuts(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...], ratio: float, epochs: int) -> DataFrame:
    """For each source: total, target, whole epochs, and the key at which the last epoch is cut, with the words left for it.

    Keys are ordered by ranges: words are summed by the first digits of the keys,
    prefix sums of those (at most 4096 a source) find the range of the cut, and that
    range alone is summed by the next digits, and so on for ``STEPS``; only the
    keys that share all those digits, one in 2**36 of a source, are then summed one
    by one. Windows over all sources hold one row a source.
    """
    width = STEPS[0]
    sums = scratch.write(rows.groupBy("grp", F.substring("key", 1, width).alias("range")).agg(F.sum("size").alias("s")), "sums")
    plan = targets(sums.groupBy("grp").agg(F.sum("s").alias("total")), weights, ratio, epochs)
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)).cast("long")
    plan = scratch.write(plan.withColumn("whole", whole).withColumn("rest", F.floor("target").cast("long") - F.col("whole") * F.col("total")), "targets")
    running = Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def cut(sums: DataFrame, rest: DataFrame) -> DataFrame:
        """The range of each source in which its sums pass what is left, and what is left there."""
        at = sums.withColumn("upto", F.sum("s").over(running)).join(_few(rest), "grp").where("upto - s <= rest and rest < upto")
        return at.select("grp", "range", (F.col("rest") - F.col("upto") + F.col("s")).alias("rest"), "s")

    at = scratch.write(cut(sums, plan.select("grp", "rest")), "at-0")
    for k, more in enumerate((*STEPS[1:], None), 1):
        inside = rows.withColumn("prefix", F.substring("key", 1, width)).join(_few(at.select("grp", F.col("range").alias("prefix"))), ["grp", "prefix"])
        width = width + more if more else 32
        sums = inside.groupBy("grp", F.substring("key", 1, width).alias("range")).agg(F.sum("size").alias("s"))
        at = scratch.write(cut(sums, at.select("grp", "rest")), f"at-{k}")
    return plan.select("grp", "total", "target", "whole").join(at.select("grp", F.col("range").alias("cut_key"), F.col("rest").alias("cut_words"), F.col("s").alias("cut_size")), "grp", "left")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, epochs: int = 2, seed: int = 0) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``taken``: the words of each that the mix takes.

    The mix is ``ratio`` times as long as all documents. A source takes whole
    epochs of its documents, then documents in the order of a hash of their id
    until its target (rounded down) is met exactly; the document at the cut gives
    the words still missing. ``taken`` is therefore at most ``epochs`` times the size.
    Rows that repeat an id stand at one place of the order; where the cut falls
    there, each gives its share rounded down. A null text has size 0 and gives
    nothing; null is a source of its own, the last. Reruns agree. Columns of the
    input stay, but for those with the names of the results, which are replaced.
    An empty table gives an empty result.
    """
    names = ["size", "source_size", "target", "taken"]
    docs = docs.select(*[docs[c] for c in docs.columns if c not in names])
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = _rows(docs, id_col, text_col, source_col, seed)
    narrow = scratch.write(rows.select(*[F.col(f"\x01{c}").alias(c) for c in ("grp", "size", "key")]), "sizes")
    plan = scratch.write(cuts(narrow, scratch, weights, ratio, epochs), "plan")
    plan = plan.select(*[F.col(c).alias(f"\x01{c}") for c in plan.columns])
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    scratch.drop("sizes")
    size, key, cut = F.col("\x01size"), F.col("\x01key"), F.col("\x01cut_key")
    last = F.when(key < cut, size).when(key == cut, F.floor(size * F.col("\x01cut_words") / F.col("\x01cut_size"))).otherwise(F.lit(0))
    out = rows.join(plan, "\x01grp")
    out = out.withColumns({"size": size, "source_size": F.col("\x01total"), "target": F.col("\x01target"), "taken": (F.col("\x01whole") * size + last).cast("long")})
    return out.select(*docs.columns, *names)


def mixed(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, **options) -> DataFrame:
    """The mix itself: each document once for each whole time it is taken, and its first words where the cut falls.

    Columns as in the input. A document without words is in the mix once, as it costs no words.
    """
    out = mix(docs, text_col=text_col, **options)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1))
    whole = F.floor(times).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, part)
    copies = F.concat(F.array_repeat(F.col(text_col), whole), F.when(part > 0, F.array(F.array_join(words, ""))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(text_col, F.explode(copies))
    if chars_col:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)
