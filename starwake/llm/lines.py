"""Line de-duplication: lines that recur over documents stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.llm.columns import plain, plain_name
from starwake.llm.text import ascii_lower, stripped
from starwake.session import cut_lineage


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key: at 10^12 different lines a false match is still unlikely."""
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("line"), key).alias("_h2")]


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """The documents without their common lines, with ``n_lines`` and ``n_dropped``.

    Lines are separated by ``\\n``; a null or empty text is one empty line. The key of a line has
    the white space at both ends removed and A-Z lowered. A key of at least ``min_chars`` code
    points in at least ``min_docs`` documents keeps its lines in the document with the largest id
    only. Other lines stay in their order, joined by ``\\n``.

    Every row is a document: repeated rows count each. Rows that share the largest id all keep the
    line, and a null id is never the largest unless all are null. All other columns are kept;
    columns already named ``n_lines`` or ``n_dropped`` are replaced. An empty table gives an empty
    result.

    Only hashes of lines are shuffled; the texts are moved once, to meet the positions of their
    dropped lines. Counting combines on the map side, so a line that a third of all documents hold
    sends one row per task; in the join such a line is split by Spark's skew handling, which needs
    the counted side to be stored, hence the checkpoint.
    """
    rows = plain(docs)
    own_id, own_text = plain_name(docs, id_col), plain_name(docs, text_col)
    keys = F.transform(F.split(ascii_lower(_text(own_text)), "\n", -1), stripped)
    lines = rows.select(
        F.col(own_id).alias("_id"), F.xxhash64(_text(own_text)).alias("_tag"), keys.alias("_keys")
    )
    long_enough = F.char_length("_key") >= min_chars
    common = cut_lineage(
        lines.select("_id", F.explode(F.array_distinct("_keys")).alias("_key"))
        .where(long_enough)
        .select("_id", *_hashes(F.col("_key")))
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last"))
        .where(F.col("_n") >= min_docs)
        .select("_h1", "_h2", "_last")
    )
    dropped = (
        lines.select("_id", "_tag", F.posexplode("_keys").alias("_at", "_key"))
        .where(long_enough)
        .select("_id", "_tag", "_at", *_hashes(F.col("_key")))
        .join(common, ["_h1", "_h2"])
        .where(~F.col("_id").eqNullSafe(F.col("_last")))
        .groupBy("_id", "_tag")
        .agg(F.collect_set("_at").alias("_gone"))
    )
    same = F.col(own_id).eqNullSafe(F.col("_id")) & (F.xxhash64(_text(own_text)) == F.col("_tag"))
    # A column of its own, or each line would split the text anew.
    met = rows.join(dropped, same, "left").withColumn("_split", F.split(_text(own_text), "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(places, lambda at: F.get("_split", at)), "\n")
    text = F.when(F.col("_gone").isNull(), _text(own_text)).otherwise(kept)
    return met.select(
        *[
            (text if name == text_col else F.col(plain_name(docs, name))).alias(name)
            for name in docs.columns
            if name not in ("n_lines", "n_dropped")
        ],
        F.size("_split").cast("bigint").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("n_dropped"),
    )
