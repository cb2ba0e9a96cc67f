"""Benchmark decontamination with SimHash windows, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.llm.columns import plain, plain_name, restored
from starwake.llm.text import ascii_lower

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of 64 bits in blocks of 8: within RADIUS bits, some block differs in two bits at most.
BITS = 64
BLOCKS = 8
RADIUS = 23
#: Bytes of a table made from the benchmark up to which it is sent to every task.
BROADCAST_BYTES = 64_000_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLOCK_BITS = BITS // BLOCKS
_NEAR = RADIUS // BLOCKS  # bits by which the closest block may differ


def _words(text: str) -> Column:
    """Runs of letters, digits and characters beyond ASCII, A-Z lowered; none for null."""
    lowered = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return F.array_remove(F.split(lowered, _SEPARATORS, -1), "")


def _shingle_hashes(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, by position."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashed = F.transform(
        starts, lambda at: F.xxhash64(*[F.get(words, at + step) for step in range(width)])
    )
    return F.when(F.size(words) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column, width: Column) -> Column:
    """The shingles themselves; one of all words where there are fewer than ``width``."""
    width = F.least(width, F.size(words))
    starts = F.sequence(F.lit(1), F.size(words) - width + 1)
    return F.transform(starts, lambda at: F.concat_ws(" ", F.slice(words, at, width)))


def simhash(words: Column) -> Column:
    """A bit is set where it is set in most hashes of the words, each as often as it occurs."""

    def with_bit(bits: Column, at: Column) -> Column:
        ones = F.aggregate(
            "_hashes", F.lit(0), lambda n, one: n + F.getbit(one, at).cast("int")
        )
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
        return F.when(ones * 2 > F.size("_hashes"), bits.bitwiseOR(bit)).otherwise(bits)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), with_bit
    )


def fingerprinted(rows: DataFrame) -> DataFrame:
    """Adds ``_print``, the SimHash of the column ``_words``."""
    hashed = rows.withColumn("_hashes", F.transform("_words", lambda word: F.xxhash64(word)))
    return hashed.withColumn("_print", simhash(F.col("_words"))).drop("_hashes")


def _block(fingerprint: Column, at: int) -> Column:
    shifted = F.shiftrightunsigned(fingerprint, at * _BLOCK_BITS)
    return shifted.bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).cast("int")


def _blocks(fingerprint: Column) -> Column:
    return F.array(
        *[F.struct(F.lit(at).alias("_at"), _block(fingerprint, at).alias("_value")) for at in range(BLOCKS)]
    )


def _small(table: DataFrame) -> DataFrame:
    """A hint to broadcast, given only after the bytes of all rows have been added up."""
    held = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    return F.broadcast(table) if held <= BROADCAST_BYTES else table


def weighted_similarity(left: Column, right: Column) -> Column:
    """Sum of the smaller over sum of the larger counts of all shingles of two arrays."""

    def summed(pick: Column) -> Column:
        def counted(total: Column, shingle: Column) -> Column:
            of = [F.size(F.filter(side, lambda one: one == shingle)) for side in (left, right)]
            return total + pick(*of)

        return F.aggregate(F.array_union(left, right), F.lit(0), counted)

    return summed(F.least) / summed(F.greatest)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Benchmark items found in documents: ``doc_id``, ``item_id``, ``start`` (word of the document,
    from 0), ``n_words``, ``distance`` of the fingerprints and ``similarity``; the best window of
    each pair, the first of equal ones. ``_tag``, a hash of the text, tells rows apart that share
    an id.

    A document's windows have the size of an item, in words. A window that shares no run of five
    words with an item of its size cannot be similar to it, so windows are laid where such a run
    stands at the same distance from both starts; one that would reach beyond the document is moved
    inside. Each gets a SimHash of its words. Fingerprints of equal window size meet in blocks: if two
    of them differ in ``RADIUS`` bits or fewer, one of ``BLOCKS`` blocks differs in two bits at most,
    and the items are indexed under all such values, so no pair within the radius is missed. Pairs
    within it are verified by the exact weighted similarity of their word shingles.

    Items and documents of fewer than five words count as one shingle. Null and empty texts match
    nothing; a null id is kept. Rows that agree in id and text give one result per item. Without
    items or documents the result is empty.

    Tables made from the benchmark are broadcast only up to ``BROADCAST_BYTES``, added up beforehand.
    """
    targets = (
        items.select(F.col(item_col).alias("item_id"), _words(item_text_col).alias("_words"))
        .where(F.size("_words") > 0)
        .withColumn("_size", F.size("_words"))
        .withColumn("_width", F.least(F.lit(SHINGLE), F.col("_size")))
    )
    widths = [row["_width"] for row in targets.select("_width").distinct().collect()]  # 5 at most
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_tag"), F.col(text_col).alias("_text")
    )
    texts = rows.select("doc_id", "_tag", _words("_text").alias("_words"))
    windows = None
    for width in sorted(widths):
        hashes = _shingle_hashes(F.col("_words"), width)
        seeds = (
            targets.where(F.col("_width") == width)
            .select("_size", F.posexplode(hashes).alias("_offset", "_seed"))
            .distinct()
        )
        runs = texts.select(
            "doc_id",
            "_tag",
            F.size("_words").alias("_of"),
            F.posexplode(hashes).alias("_at", "_seed"),
        )
        last = F.greatest(F.col("_of") - F.col("_size"), F.lit(0))
        laid = runs.join(_small(seeds), "_seed").select(
            "doc_id",
            "_tag",
            F.least(F.greatest(F.col("_at") - F.col("_offset"), F.lit(0)), last).alias("start"),
            "_size",
        )
        windows = laid if windows is None else windows.union(laid)
    if windows is None:
        windows = texts.select("doc_id", "_tag", F.lit(0).alias("start"), F.lit(0).alias("_size")).limit(0)
    of_doc = (
        windows.distinct()
        .groupBy("doc_id", "_tag")
        .agg(F.collect_list(F.struct("start", "_size")).alias("_windows"))
        .withColumnsRenamed({"doc_id": "_doc", "_tag": "_tag_of"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_tag") == F.col("_tag_of"))
    met = rows.join(of_doc, same)  # texts are moved whole and split afterwards, words would be larger
    cut = (
        met.select("doc_id", "_tag", _words("_text").alias("_words"), "_windows")
        .select("doc_id", "_tag", "_words", F.explode("_windows").alias("_window"))
        .select(
            "doc_id",
            "_tag",
            "_window.*",
            F.slice("_words", F.col("_window.start") + 1, F.col("_window._size")).alias("_words"),
        )
    )
    bits = [1 << bit for bit in range(_BLOCK_BITS)]
    flips = F.array(*[F.lit(flip) for flip in sorted({0, *bits, *(a | b for a in bits for b in bits)})])
    verified = targets.select(
        F.xxhash64("_words").alias("_key"), _shingles(F.col("_words"), F.col("_width")).alias("_item_shingles")
    ).dropDuplicates(["_key"])  # apart from the index, which has many rows an item
    index = (
        fingerprinted(targets)
        .select(
            "item_id",
            "_size",
            F.col("_print").alias("_item_print"),
            F.xxhash64("_words").alias("_key"),
            F.explode(_blocks(F.col("_print"))).alias("_block"),
        )
        .select("*", F.explode(flips).alias("_flip"))
        .select(
            "item_id",
            "_size",
            "_item_print",
            "_key",
            "_block._at",
            F.col("_block._value").bitwiseXOR(F.col("_flip")).alias("_value"),
        )
    )
    probes = (
        fingerprinted(cut)
        .withColumn("_block", F.explode(_blocks(F.col("_print"))))
        .select("doc_id", "_tag", "start", "_size", "_words", "_print", "_block._at", "_block._value")
    )
    apart = F.col("_print").bitwiseXOR(F.col("_item_print"))
    first = F.coalesce(
        *[F.when(F.bit_count(_block(apart, at)) <= _NEAR, F.lit(at)) for at in range(BLOCKS)]
    )
    return (
        probes.join(_small(index), ["_size", "_at", "_value"])
        .where((F.bit_count(apart) <= RADIUS) & (first == F.col("_at")))
        .join(_small(verified), "_key")
        .withColumn("_shingles", _shingles(F.col("_words"), F.least(F.lit(SHINGLE), F.col("_size"))))
        .withColumn("similarity", weighted_similarity(F.col("_shingles"), F.col("_item_shingles")))
        .where(F.col("similarity") >= similarity)
        .groupBy("doc_id", "_tag", "item_id")
        .agg(
            F.max(
                F.struct(
                    "similarity",
                    (-F.col("start")).alias("at"),
                    F.size("_words").alias("n_words"),
                    F.bit_count(apart).alias("distance"),
                )
            ).alias("_best")
        )
        .select(
            "doc_id",
            "_tag",
            "item_id",
            (-F.col("_best.at")).cast("bigint").alias("start"),
            F.col("_best.n_words").cast("bigint").alias("n_words"),
            F.col("_best.distance").cast("bigint").alias("distance"),
            "_best.similarity",
        )
    )


def drop_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The documents in which no item was found, with all their columns."""
    found = find_leaks(docs, items, id_col, text_col, **options)
    leaked = found.select(F.col("doc_id").alias("_leaked"), F.col("_tag").alias("_leaked_tag")).distinct()
    own_id, own_text = plain_name(docs, id_col), plain_name(docs, text_col)
    same = F.col(own_id).eqNullSafe(F.col("_leaked")) & (F.xxhash64(own_text) == F.col("_leaked_tag"))
    return restored(plain(docs).join(leaked, same, "left_anti"), docs)
