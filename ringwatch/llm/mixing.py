"""Mix sources to target weights by balanced sampling with the cube method.

Sources, in code point order with null last, weigh 1, 2, 3, 1, ... and share the words of all
documents; a source takes at most `most` times its own size, and what exceeds that is shared anew
by weight. Every document of a source is taken floor(target / size) times, and once more with
the fractional probability that remains. That last draw is balanced: blocks of documents run the
flight phase of the cube method (Chauvet and Tille 2006), which moves three fractional
probabilities at a time along the null space of (documents, words) until one of them is 0 or 1.
A block ends with two open documents at most; these meet in fewer and fewer blocks, until two
are left in a source, which land on the nearest totals.

Random moves are seeded by block, blocks and their order are hashes of the row, so reruns agree.

Edge cases: a null or empty text has size 0 and is never taken; a source of size 0 has target 0;
repeated rows are documents of their own. The mix needs doc_id, text and source; a missing
column counts as null.
"""

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwatch.llm.common import BROADCAST_ROWS, SPACE, with_missing
from ringwatch.session import cut_lineage

MOST = 3
BLOCK_ROWS = 2_000
EDGE = 1e-9
OPEN_SCHEMA = "sid long, tie long, doc_id long, size long, base long, pi double"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """(sid, source, source_size, docs, weight): sources in code point order, null last."""
    last = F.col("source").isNull()
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("docs"))
    ranged = cut_lineage(per_source.repartitionByRange(last, F.col("source")).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").count().orderBy("_part").collect()  # one row per shuffle partition
    offsets, so_far = {}, 0
    for row in counts:
        offsets[row["_part"]] = so_far
        so_far += row["count"]
    offset = F.coalesce(*[F.when(F.col("_part") == p, F.lit(o)) for p, o in offsets.items()], F.lit(0)) if offsets else F.lit(0)
    in_part = Window.partitionBy("_part").orderBy(last, "source")
    sid = (F.row_number().over(in_part) - 1 + offset).cast("long")
    return ranged.withColumn("sid", sid).withColumn("weight", (F.col("sid") % 3 + 1).cast("double")).drop("_part")


def water_level(sources: DataFrame, most: float) -> float:
    """The words per weight at which targets below their limit add up to all words.

    Each round frees the sources above their limit; one aggregated row comes back per round.
    """
    level = 0.0
    while True:
        over = F.col("weight") * level > most * F.col("source_size")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, most * F.col("source_size"))).alias("held"),
            F.sum(F.when(~over & (F.col("source_size") > 0), F.col("weight"))).alias("open"),
        ).first()
        if not row["total"] or not row["open"]:
            return level
        new = (row["total"] - (row["held"] or 0)) / row["open"]
        if new <= level:
            return level
        level = new


def source_targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    sources = cut_lineage(numbered_sources(sizes))
    level = water_level(sources, most)
    return sources.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size").cast("double")))


def flight(size: np.ndarray, pi: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight phase: all but two at most are 0 or 1.

    Sums of the probabilities and of size times probability stay as they were.
    """
    rng, pi = random.Random(seed), pi.copy()
    held: list[int] = []
    sizes = [float(s) for s in size]
    p = [float(x) for x in pi]
    for i in range(len(p)):
        if EDGE < p[i] < 1 - EDGE:
            held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(held, u) if x)
        down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(held, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for k, x in zip(held, u):
            p[k] += step * x
            p[k] = 0.0 if p[k] <= EDGE else 1.0 if p[k] >= 1 - EDGE else p[k]
        held = [k for k in held if 0.0 < p[k] < 1.0]
    return np.array(p)


def land(size: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Round the last open probabilities (two at most) to the totals nearest to the expected ones."""
    open_at = np.flatnonzero((pi > EDGE) & (pi < 1 - EDGE))
    if not len(open_at):
        return np.round(pi)
    best = None
    for bits in range(1 << len(open_at)):
        choice = np.array([(bits >> j) & 1 for j in range(len(open_at))], dtype=float)
        off = choice - pi[open_at]
        cost = abs(float(off @ size[open_at])) + abs(off.sum()) * float(size[open_at].mean())
        if best is None or cost < best[0]:
            best = (cost, choice)
    out = np.round(pi)
    out[open_at] = best[1]
    return out


def fly_blocks(rows: DataFrame, blocks: Column, ground: Column) -> DataFrame:
    """Run the flight in each (sid, block); where `ground` holds, the block also lands."""

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tie", "doc_id", "size"], kind="stable")
        size, pi = pdf["size"].to_numpy(dtype=float), pdf["pi"].to_numpy()
        seed = int(pdf["sid"].iloc[0]) * 1_000_003 + int(pdf["_block"].iloc[0])
        pi = flight(size, pi, seed)
        pdf["pi"] = land(size, pi) if bool(pdf["_ground"].iloc[0]) else pi
        return pdf.drop(columns="_parts")

    return rows.withColumns({"_block": blocks, "_ground": ground}).groupBy("sid", "_block").applyInPandas(
        move, OPEN_SCHEMA + ", _block long, _ground boolean"
    )


def balanced_draws(rows: DataFrame, counts: DataFrame, block_rows: int) -> DataFrame:
    """`rows` (OPEN_SCHEMA) with pi drawn to 0 or 1; `counts` has sid and docs, few rows or many."""
    spark, done = rows.sparkSession, []
    largest = counts.agg(F.max("docs")).first()[0] or 0
    parts = F.greatest(F.ceil(F.col("docs") / block_rows), F.lit(1)).cast("long")
    current = rows.join(counts.withColumn("_parts", parts).select("sid", "_parts"), "sid")
    blocks = F.pmod(F.col("tie"), F.col("_parts"))
    while True:
        moved = cut_lineage(fly_blocks(current, blocks, F.col("_parts") == 1))
        last = largest <= block_rows
        is_open = (F.col("pi") > EDGE) & (F.col("pi") < 1 - EDGE)
        done.append((moved if last else moved.where(~is_open)).drop("_block", "_ground"))
        if last:
            break
        # every block leaves two open documents at most
        left = cut_lineage(moved.where(is_open).drop("_block", "_ground"))
        per_source = left.groupBy("sid").agg(F.count(F.lit(1)).alias("docs"))
        largest = left.groupBy("sid").count().agg(F.max("count")).first()[0] or 0
        current = left.join(per_source.withColumn("_parts", parts).select("sid", "_parts"), "sid")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix_sources(docs: DataFrame, most: int = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (0 to `most`), taken."""
    docs = with_missing(docs, doc_id="long", text="string", source="string")
    sizes = cut_lineage(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(31), "doc_id", "text").alias("tie"))
    )
    sources = cut_lineage(source_targets(sizes, most))
    few = sources.count() <= BROADCAST_ROWS
    facts = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    base = F.coalesce(F.floor(ratio + EDGE), F.lit(0)).cast("long")
    rows = (
        sizes.withColumn("_s", F.coalesce("source", F.lit("")))
        .withColumn("_null", F.col("source").isNull())
        .join(
            facts(sources.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"), "sid", "source_size", "target")),
            ["_s", "_null"],
        )
    )
    plan = rows.select(
        "sid",
        "tie",
        F.col("doc_id").cast("long").alias("doc_id"),
        "size",
        base.alias("base"),
        F.when(F.col("size") > 0, F.greatest(F.coalesce(ratio, F.lit(0.0)) - base, F.lit(0.0))).otherwise(0.0).alias("pi"),
    )
    drawn = balanced_draws(plan, facts(sources.select("sid", "docs")), block_rows)
    copies = F.when(F.col("size") > 0, F.col("base") + F.round("pi").cast("long")).otherwise(F.lit(0).cast("long"))
    return drawn.join(facts(sources.select("sid", "source", "source_size", "target")), "sid").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "tie"
    )
