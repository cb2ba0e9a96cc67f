"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwake.llm.columns import plain, plain_name, restored
from starwake.llm.text import n_words
from starwake.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Virtual time up to 1 is cut into so many slots to find where the budget is used up.
SLOTS = 1 << 16
#: Hex digits of the shuffled order that name a bucket of a source's documents.
BUCKET_DIGITS = 3

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """One row per source of ``sizes(_source, _size)``: ``_no``, ``source_size`` and ``target``.

    Sources in order of code points, null last, take the weights in turn and share the total size.
    A target above ``max_copies`` times its source's size stops there and its excess goes to the
    others by weight. With the sources sorted by limit / weight the stopped ones come first, so
    running sums give the level at which the others stand. The windows over everything see one row
    per source.
    """
    limit = F.col("source_size") * max_copies
    by_ratio = Window.orderBy("_ratio", "_no")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nth = (F.pmod(F.col("_no") - 1, F.lit(len(weights))) + 1).cast("int")
    level = (
        F.sum("source_size").over(everything)
        - F.coalesce(F.sum(limit).over(by_ratio.rowsBetween(*_BEFORE)), F.lit(0))
    ).cast("double") / F.sum("_weight").over(onward)
    return (
        sizes.groupBy("_source")
        .agg(F.sum("_size").alias("source_size"))
        .withColumn(
            "_no", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
        )
        .withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), nth))
        .withColumn("_ratio", limit.cast("double") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn(
            "_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
        )
        .select(
            "_source",
            "_no",
            "source_size",
            F.least(limit.cast("double"), F.col("_level") * F.col("_weight")).alias("target"),
        )
    )


def _finish(copy: int) -> Column:
    """Virtual time at which a copy of a document leaves the queue of its source."""
    served = F.col("source_size") * copy + F.col("_served")
    return F.when(F.col("target") > 0, served.cast("double") / F.col("target"))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """How often the mix takes each document.

    A row per row of ``docs``: ``doc_id``, ``source``, ``_tag`` (hash of the text), ``size`` in
    words, ``source_size``, ``target`` of its source, ``copies`` and ``taken`` words.

    Each source is a queue of its documents in an order shuffled by the MD5 of the id, gone through
    up to ``max_copies`` times. A copy's virtual finish time is the number of words its source has
    served with it, divided by the source's target. The mix is all copies in order of finish times,
    cut off where the next time would go beyond the total size; equal times stand or fall together.

    Null or blank texts have size 0. A null id is shuffled as an empty text. Repeated rows are
    documents of their own. A source of size 0 has target 0 and nothing is taken from it. An empty
    table gives an empty result.

    Sizes are stored once, so texts are read once and never shuffled. Running sums are built from
    sums per (source, bucket of the shuffled order), and the cut from sums per slot of virtual time:
    both deal rows out evenly, whatever the sizes of the sources.
    """
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("_source"),
            F.xxhash64(text_col).alias("_tag"),
            n_words(F.col(text_col)).alias("_size"),
        )
    )
    targets = source_targets(rows, weights, max_copies)
    shuffled = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary"))
    placed = (
        rows.join(targets.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")))
        .drop("_of")
        .withColumn("_key", shuffled)
        .withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    )
    earlier = (
        placed.groupBy("_no", "_bucket")
        .agg(F.sum("_size").alias("_sum"))
        .select(
            "_no",
            "_bucket",
            F.coalesce(
                F.sum("_sum").over(Window.partitionBy("_no").orderBy("_bucket").rowsBetween(*_BEFORE)),
                F.lit(0),
            ).alias("_earlier"),
        )
    )
    within = Window.partitionBy("_no", "_bucket").orderBy("_key", "_id", "_size", "_tag")
    queued = cut_lineage(
        placed.withColumn("_in_bucket", F.sum("_size").over(within.rowsBetween(*_SO_FAR)))
        .join(earlier, ["_no", "_bucket"])
        .withColumn("_served", F.col("_earlier") + F.col("_in_bucket"))
        .drop("_bucket", "_key", "_earlier", "_in_bucket")
    )
    copies = F.array(*[_finish(copy) for copy in range(max_copies)])
    events = queued.select("_size", F.explode(copies).alias("_finish")).where("_finish is not null")
    slots = (
        events.groupBy(F.floor(F.col("_finish") * SLOTS).alias("_slot"))
        .agg(F.sum("_size").alias("_sum"), F.max("_finish").alias("_latest"))
        .withColumn(
            "_until", F.sum("_sum").over(Window.orderBy("_slot").rowsBetween(*_SO_FAR))
        )
    )
    budget = targets.agg(F.sum("source_size").alias("_budget")).first()["_budget"] or 0
    whole = slots.where(F.col("_until") <= budget).agg(
        F.max("_slot").alias("slot"), F.max("_until").alias("until"), F.max("_latest").alias("latest")
    ).first()
    rest = (
        events.where(F.floor(F.col("_finish") * SLOTS) == _next_slot(slots, whole["slot"]))
        .groupBy("_finish")
        .agg(F.sum("_size").alias("_sum"))
        .withColumn("_until", F.sum("_sum").over(Window.orderBy("_finish").rowsBetween(*_SO_FAR)))
        .where(F.col("_until") <= budget - (whole["until"] or 0))
        .agg(F.max("_finish").alias("latest"))
        .first()["latest"]
    )
    cut = rest if rest is not None else whole["latest"] if whole["latest"] is not None else -1.0
    taken = sum(
        (F.when(_finish(copy) <= cut, 1).otherwise(0) for copy in range(max_copies)), F.lit(0)
    )
    return queued.withColumn("copies", taken).select(
        F.col("_id").alias("doc_id"),
        F.col("_source").alias("source"),
        "_tag",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("_size")).alias("taken"),
    )


def _next_slot(slots: DataFrame, slot: int | None) -> int:
    """The first slot that holds copies after the last one that is taken whole, or -1."""
    later = slots if slot is None else slots.where(F.col("_slot") > slot)
    found = later.agg(F.min("_slot").alias("slot")).first()["slot"]
    return -1 if found is None else found


def mix_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents of the mix: each row as often as :func:`mix_plan` takes it, columns unchanged.

    Rows that agree in id, source and text are matched with their plans in order of copies. Only
    here texts are shuffled, once, to meet their number of copies.
    """
    same = ["_id", "_source", "_tag"]
    plan = mix_plan(docs, id_col, text_col, source_col, weights, max_copies)
    plan = plan.where(F.col("copies") > 0).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_tag", "copies"
    )
    plan = plan.groupBy(*same).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    own = [plain_name(docs, name) for name in (id_col, source_col, text_col)]
    rows = plain(docs).withColumns(
        {
            "_id_of_row": F.col(own[0]),
            "_source_of_row": F.col(own[1]),
            "_tag_of_row": F.xxhash64(own[2]),
        }
    )
    of_row = [f"{name}_of_row" for name in same]
    nth = F.row_number().over(Window.partitionBy(*of_row).orderBy(F.lit(0)))
    match = [F.col(f"{name}_of_row").eqNullSafe(F.col(name)) for name in same]
    taken = (
        rows.withColumn("_nth", nth)
        .join(plan, match[0] & match[1] & match[2])
        .withColumn("_take", F.get("_copies", F.col("_nth") - 1))
        .where(F.col("_take").isNotNull())
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_take"))))
    )
    return restored(taken, docs)
