"""Running totals, exact quantiles and row numbers without a one-task window.

A window over a whole run or feature sorts that group in one task. Here the rows are
first put in order-keeping bins. Inside a bin the window is small; across bins only one
total per bin is left, and their number is bounded by the bins, not by the rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwatch.functions.hashing import digest
from ringwatch.functions.numbers import value_bin
from ringwatch.operators.skew import BROADCAST_MAX_ROWS, join_counted
from ringwatch.session import cut_lineage

_ALL = "_all"
#: rows up to which a bin is sorted as it is; ranges a larger one is split into; splits that use up a double's digits
SMALL_BIN, SPLITS, MAX_SPLITS = 1_000_000, 4096, 3


def _with_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def _range_bins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The rows with `_bin`, their place in a range partitioning by keys and order; written once.

    The ranges are cut from a sample of the rows, so values that lie close together and texts
    that share a start spread over bins like any others. The numbers of the bins may differ
    between runs; sums over whole bins do not depend on where they are cut.
    """
    ordered = rows.withColumn("_order", order)
    return cut_lineage(ordered.repartitionByRange(*keys, "_order").withColumn("_bin", F.spark_partition_id()).drop("_order"))


def _offsets(binned: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """One row per key and bin: what lies in earlier bins, and the total of the key."""
    per_bin = binned.groupBy(*keys, "_bin").agg(*[v.alias(m) for m, v in totals.items()])
    over = Window.partitionBy(*keys)
    before = over.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return per_bin.select(
        *keys,
        "_bin",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in totals],
        *[F.sum(m).over(over).alias(f"{m}_total") for m in totals],
    )


def prefix_sums(
    hist: DataFrame, keys: list[str], value: str, measures: list[str], ascending: bool = True,
    small_groups: bool = False,
) -> DataFrame:
    """Add `{m}_before` (sum over strictly smaller values) and `{m}_total` per key.

    `hist` must hold one row per key and value. `small_groups` says that every key is known to
    have few values and takes one window per key; else bins are used.
    """
    plain = list(hist.columns)
    if small_groups:
        whole = Window.partitionBy(*keys)
        ordered = whole.orderBy(F.col(value) if ascending else F.desc(value))
        earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
        return hist.select(
            *plain,
            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
        )
    rows, keys = _with_keys(hist, keys)
    order = F.col(value) if ascending else -F.col(value)
    rows = _range_bins(rows, keys, order)
    offsets = _offsets(rows, keys, {m: F.sum(m) for m in measures})
    inside = (
        Window.partitionBy(*keys, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumns({f"_in_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
        .join(offsets, [*keys, "_bin"])
        .select(
            *plain,
            *[(F.col(f"_in_{m}") + F.col(f"_off_{m}")).alias(f"{m}_before") for m in measures],
            *[f"{m}_total" for m in measures],
        )
    )


def fraction(q: float) -> tuple[int, int]:
    """The quantile as a whole-number fraction, so that ranks carry no float noise."""
    from fractions import Fraction

    f = Fraction(str(q))
    return f.numerator, f.denominator


def rank_parts(q: float, n: Column) -> tuple[Column, Column]:
    """Lower rank and the way to the next one, for linear interpolation over n rows."""
    num, den = fraction(q)
    scaled = F.lit(num) * (n - 1)
    low = (scaled - F.pmod(scaled, F.lit(den))) / F.lit(float(den))
    return low.cast("bigint"), F.pmod(scaled, F.lit(den)) / F.lit(float(den))


def quantile_columns(value: str, n: str, before: str, total: str, quantiles: dict[str, float]) -> list[Column]:
    """Aggregates that read exact quantiles off a histogram with running totals."""
    out = []
    for name, q in quantiles.items():
        low, share = rank_parts(q, F.col(total))

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col(before) <= rank) & (rank < F.col(before) + F.col(n)), F.col(value)))

        high = F.least(low + 1, F.col(total) - 1)
        out.append((at(low) + (at(high) - at(low)) * F.max(share)).alias(name))
    return out


def _bins_at_ranks(bins: DataFrame, keyed: list[str], quantiles: dict[str, float]) -> DataFrame:
    """The bins (with `_off_c`, `_end` and `c_total`) that hold a wanted rank."""
    wanted = F.lit(False)
    for q in quantiles.values():
        low, _ = rank_parts(q, F.col("c_total"))
        for rank in (low, F.least(low + 1, F.col("c_total") - 1)):
            wanted = wanted | ((F.col("_off_c") <= rank) & (rank < F.col("_end")))
    return cut_lineage(bins.where(wanted).select(*keyed, "_bin", "_off_c", "_end", "c_total"))


def _split_bins(rows: DataFrame, bins: DataFrame, keyed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of wanted bins in SPLITS equal ranges each, between the lowest and highest value of the bin,
    and the counts of these finer bins."""
    at = [*keyed, "_bin"]
    inside = join_counted(rows, bins, at)
    ends = inside.groupBy(*at).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(share * SPLITS), F.lit(SPLITS - 1))).otherwise(F.lit(0)).cast("bigint")
    finer = join_counted(inside.select(*at, "_v"), ends, at).select(*keyed, "_bin", (F.col("_bin") * SPLITS + part).alias("_part"), "_v")
    counts = finer.groupBy(*at, "_part").agg(F.count(F.lit(1)).alias("_c")).join(bins, at)
    upto = Window.partitionBy(*at).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("_off_c") + F.sum("_c").over(upto)
    counts = counts.withColumn("_to", end).select(
        *keyed, F.col("_part").alias("_bin"), (F.col("_to") - F.col("_c")).alias("_off_c"), F.col("_to").alias("_end"), "c_total"
    )
    return finer.select(*keyed, F.col("_part").alias("_bin"), "_v"), counts


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], keys: list[str] | None = None, small_bin: int = SMALL_BIN
) -> DataFrame:
    """Linear-interpolated quantiles per key, nulls left out, by narrowing the ranges that hold their ranks.

    The first pass counts order-keeping bins, by magnitude. Bins that hold a wanted rank and more
    rows than `small_bin` (a column of a narrow relative range, such as times) are split into equal
    ranges and counted again, until they are small or the numbers have no digits left. Only the
    distinct values of the last bins are sorted, so the full column is never shuffled.
    The wanted bins (at most two per quantile and key) are written and counted at once.
    """
    keys = keys or []
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    rows, keyed = _with_keys(rows, keys)
    rows = rows.withColumn("_bin", value_bin(F.col("_v")))
    bins = _offsets(rows.withColumn("_one", F.lit(1)), keyed, {"c": F.sum("_one")})
    ends = F.lead("_off_c").over(Window.partitionBy(*keyed).orderBy("_bin"))
    bins = _bins_at_ranks(bins.withColumn("_end", F.coalesce(ends, F.col("c_total"))), keyed, quantiles)
    size = F.struct(F.max(F.col("_end") - F.col("_off_c")).alias("largest"), F.count(F.lit(1)).alias("n"))
    for k in range(MAX_SPLITS + 1):
        seen = bins.agg(size.alias("s")).first()["s"]
        if (seen["largest"] or 0) <= small_bin or k == MAX_SPLITS:
            break
        rows, counts = _split_bins(rows, bins, keyed)
        bins = _bins_at_ranks(counts, keyed, quantiles)
    few = bins.drop("_end")
    hist = (
        rows.join(F.broadcast(few) if seen["n"] <= BROADCAST_MAX_ROWS else few, [*keyed, "_bin"])
        .groupBy(*keyed, "_bin", "_v", "_off_c", "c_total")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    inside = Window.partitionBy(*keyed, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.col("_off_c") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return (
        hist.groupBy(*keyed).agg(*quantile_columns("_v", "_n", "_before", "c_total", quantiles)).select(*keys, *quantiles)
    )


def row_numbers(
    df: DataFrame, keys: list[str], identity: list[str], seed: int | str, name: str = "rn", digits: int = 4
) -> DataFrame:
    """Number the rows of each key from 0 in a seeded random order that any run repeats."""
    plain = list(df.columns)
    rows, keyed = _with_keys(df, keys)
    rows = rows.withColumn("_h", digest(seed, *identity)).withColumn("_bin", F.substring("_h", 1, digits))
    offsets = _offsets(rows.withColumn("_one", F.lit(1)), keyed, {"c": F.sum("_one")})
    inside = Window.partitionBy(*keyed, "_bin").orderBy("_h", *identity)
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(offsets, [*keyed, "_bin"])
        .select(*plain, (F.col("_in") + F.col("_off_c")).alias(name), F.col("c_total").alias(f"{name}_total"))
    )


def text_row_numbers(df: DataFrame, keys: list[str], text: str, name: str = "rn") -> DataFrame:
    """Number distinct texts of each key from 0 in text order."""
    plain = list(df.columns)
    rows, keyed = _with_keys(df, keys)
    rows = _range_bins(rows, keyed, F.col(text))
    offsets = _offsets(rows.withColumn("_one", F.lit(1)), keyed, {"c": F.sum("_one")})
    inside = Window.partitionBy(*keyed, "_bin").orderBy(text)
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(offsets, [*keyed, "_bin"])
        .select(*plain, (F.col("_in") + F.col("_off_c")).alias(name))
    )


def mid_ranks(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "rank_share") -> DataFrame:
    """Share-of-rows rank with ties on their mean rank, per distinct value."""
    keys = keys or []
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(hist, keys, value, ["n"])
    return ranked.select(
        *keys, value, "n", ((F.col("n_before") + (F.col("n") + 1) / 2.0) / F.col("n_total")).alias(name)
    )
