"""Keep the longest of the snapshots in which a conversation was logged, then render it.

A conversation that is a prefix of another holds nothing new. Each turn is hashed with its place,
and the running exclusive-or of these hashes names every prefix in 128 bits. Whole conversations
are anti-joined with the proper prefixes of all others; of equal ones the smallest conv_id stays.

Turns are ordered by (turn, role, text), nulls first; rows that repeat a turn entirely count once,
and rows without conv_id are left out. A null role or text is a value of its own when prefixes
are compared and renders as empty. Long conversations are hashed and rendered in ranges of
turns, so no window holds more than one range. Input columns beyond the four are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwatch.llm.common import two_hashes, with_missing
from ringwatch.session import cut_lineage

RANGE = 256
COLUMNS = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}


def placed_turns(turns: DataFrame, span: int = RANGE) -> DataFrame:
    """Distinct turns with their range, their place in the conversation and the hashes of role and text."""
    rows = with_missing(turns, **COLUMNS).where("conv_id is not null").select(*COLUMNS).distinct()
    rows = rows.withColumn("_range", F.coalesce(F.floor(F.col("turn") / span), F.lit(-(2**62))))
    in_range = Window.partitionBy("conv_id", "_range")
    return rows.withColumn("_n", F.row_number().over(in_range.orderBy("turn", "role", "text")))


def prefixes(placed: DataFrame) -> DataFrame:
    """(conv_id, n, p1, p2, last): the hashes of the first n turns, for every n."""
    sizes = placed.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_rows"))
    by_conv = Window.partitionBy("conv_id").orderBy("_range")
    before = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumns(
        {"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_all": F.sum("_rows").over(Window.partitionBy("conv_id"))}
    )
    named = placed.join(offsets, ["conv_id", "_range"]).withColumn("n", F.col("_before") + F.col("_n"))
    h1, h2 = two_hashes(F.col("n"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    hashed = cut_lineage(named.select("conv_id", "_range", "n", "_all", h1.alias("h1"), h2.alias("h2")))
    whole = hashed.groupBy("conv_id", "_range").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    carried = whole.select("conv_id", "_range", *[F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(f"c{t[1]}") for t in ("t1", "t2")])
    inside = Window.partitionBy("conv_id", "_range").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("conv_id", "_range", "n", "_all", *[F.bit_xor(h).over(inside).alias(f"r{h[1]}") for h in ("h1", "h2")])
    return running.join(carried, ["conv_id", "_range"]).select(
        "conv_id",
        "n",
        F.col("r1").bitwiseXOR(F.col("c1")).alias("p1"),
        F.col("r2").bitwiseXOR(F.col("c2")).alias("p2"),
        (F.col("n") == F.col("_all")).alias("last"),
    )


def maximal_conversations(placed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): conversations that no other one extends, n_equal of them alike."""
    found = cut_lineage(prefixes(placed))
    whole = found.where("last").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    proper = found.where("not last").select("n", "p1", "p2").distinct()
    return whole.join(proper, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_equal")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_chats(turns: DataFrame, span: int = RANGE) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered) of the maximal conversations."""
    placed = cut_lineage(placed_turns(turns, span))
    kept = cut_lineage(maximal_conversations(placed))
    pieces = placed.join(kept, "conv_id", "left_semi").select(
        "conv_id", "_range", F.struct("_n", render_turn(F.col("role"), F.col("text")).alias("t")).alias("_turn")
    )
    join = lambda name, c: F.concat_ws("", F.transform(F.array_sort(F.collect_list(name)), lambda x: x[c]))
    ranges = pieces.groupBy("conv_id", "_range").agg(join("_turn", "t").alias("t"))
    texts = ranges.select("conv_id", F.struct("_range", "t").alias("_part")).groupBy("conv_id").agg(join("_part", "t").alias("rendered"))
    return kept.join(texts, "conv_id")
