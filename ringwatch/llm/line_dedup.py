"""Drop lines that many documents share.

Every text is exploded to lines once. A line's key (spaces stripped at both ends, A-Z lowered) is
hashed to 128 bits, documents are counted per hash with map-side combine, and only the positions
of lines over the threshold go back to their documents. Texts move once, for that last join.

Edge cases: a null or empty text is one empty line, which has no code points and always stays.
A document that loses all its lines has an empty text. Rows that repeat a doc_id count as one
document; rows without doc_id count by their text. Input columns called `kept_text`, `n_lines` or
`n_dropped` are replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import SPACE, counted, lower_ascii, replacing, two_hashes, with_missing
from ringwatch.session import cut_lineage


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    spaces = F.lit(" \t\n\x0b\x0c\r")
    return lower_ascii(F.btrim(line, spaces))


def line_table(docs: DataFrame) -> DataFrame:
    """(_k1, _k2, _doc, _pos, _h1, _h2): the hashed lines of each row. _k1, _k2 name the row by content."""
    k1, k2 = two_hashes(F.col("doc_id"), F.col("text"))
    exploded = docs.select(
        k1.alias("_k1"),
        k2.alias("_k2"),
        F.coalesce(F.xxhash64(F.lit(5), F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("string"))), k1).alias("_any"),
        F.col("doc_id").isNull().alias("_no_id"),
        F.posexplode(lines_of(F.col("text"))).alias("_pos", "_line"),
    )
    keyed = exploded.withColumn("_key", line_key(F.col("_line")))
    h1, h2 = two_hashes(F.col("_key"))
    return keyed.select(
        "_k1",
        "_k2",
        F.when(F.col("_no_id"), F.col("_k1")).otherwise(F.col("_any")).alias("_doc"),
        "_pos",
        h1.alias("_h1"),
        h2.alias("_h2"),
        F.length("_key").alias("_len"),
    )


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` with kept_text, n_lines and n_dropped; lines found in `min_docs` documents go everywhere."""
    docs = replacing(with_missing(docs, doc_id="long", text="string"), "kept_text", "n_lines", "n_dropped")
    lines = cut_lineage(line_table(docs).where(F.col("_len") >= min_chars).drop("_len"))
    shared = (
        lines.select("_h1", "_h2", "_doc")
        .distinct()
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_docs"))
        .where(F.col("_docs") >= min_docs)
        .select("_h1", "_h2")
    )
    # written, so that the last join has a shuffle of its own on both sides and can split repeated rows
    drops = cut_lineage(
        lines.join(counted(shared), ["_h1", "_h2"], "left_semi")
        .groupBy("_k1", "_k2")
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    k1, k2 = two_hashes(F.col("doc_id"), F.col("text"))
    marked = docs.withColumns({"_k1": k1, "_k2": k2}).join(drops, ["_k1", "_k2"], "left")
    lines_now = lines_of(F.col("text"))
    kept = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.filter(lines_now, lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    )
    return marked.withColumns(
        {
            "kept_text": kept,
            "n_lines": F.size(lines_now).cast("long"),
            "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        }
    ).drop("_k1", "_k2", "_gone")
