"""Near-duplicate vectors within a label through an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; the pairs of centres form a
grid of cells. Every vector lies in its home cell and visits the cells whose summed squared
distances of its halves to their centres lie within a margin above its home. They are walked in
the two sorted lists of distances (the multi-sequence traversal), so only cells that are visited are
made. Pairs that meet are compared exactly, in double precision. A pair can meet at the home of
either end; it is counted once for both ends, whichever of them found it.

The codebooks and the margin come from a bounded sample (`SAMPLE` distinct vectors, by hash). For
the margin each sampled vector is turned to exactly the least similarity in a random direction,
and the margin is the one within which a share of `recall` of these twins has its home. That is
the worst case, as closer pairs are found more often.

Equal vectors of a label are one class with a count. The vectors of a cell meet in tiles of
bounded size, so a dense cell is spread over tasks; a tile returns counts and the edges of a
spanning forest, never its pairs.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite number, and those
without label, link with nothing. Vectors of different length do not link. Rows without vec_id
are returned with a null component and kept. A class is named by its smallest vec_id.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwatch.llm.common import counted, with_missing
from ringwatch.operators.components import connected_components
from ringwatch.session import cut_lineage

LEAST_COSINE = 0.93
RECALL = 0.995
SAMPLE = 20_000
PER_CELL = 64
TILE = 1024
SEED = 7


def packed(vectors: DataFrame, wide: bool) -> DataFrame:
    """(vec_id, label, dim, k1, k2, vec): numbers as bytes, null where the vector links with nothing."""
    kind = np.dtype("<f8" if wide else "<f4")
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("vec", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, k1, k2, vecs = [], [], [], []
            for cell, label in zip(batch.column("embedding"), batch.column("label")):
                v = None if cell.as_py() is None else np.asarray(cell.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                ok = v is not None and label.is_valid and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                data = (v + 0.0).astype(kind).tobytes() if ok else None
                name = xxhash.xxh3_128_digest(label.as_py().encode() + b"\0" + data) if ok else b"\0" * 16
                dims.append(len(v) if ok else 0)
                k1.append(int.from_bytes(name[:8], "big", signed=True))
                k2.append(int.from_bytes(name[8:], "big", signed=True))
                vecs.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), *map(pa.array, (dims, k1, k2)), pa.array(vecs, pa.binary())], schema=schema
            )

    return vectors.mapInArrow(pack, "vec_id long, label string, dim long, k1 long, k2 long, vec binary")


def unit_rows(column: list[bytes], wide: bool) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that large and small numbers do not overflow."""
    rows = np.frombuffer(b"".join(column), dtype="<f8" if wide else "<f4").reshape(len(column), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def squared_distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)[None, :]


def codebook(rows: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    centres = rows[np.random.default_rng(SEED).choice(len(rows), min(size, len(rows)), replace=False)]
    for _ in range(rounds):
        home = squared_distances(rows, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        n = np.bincount(home, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Grid:
    """Two codebooks and the margin of the traversal."""

    def __init__(self, sample: np.ndarray, size: int, least: float, recall: float):
        self.half = max(sample.shape[1] // 2, 1)
        self.books = [codebook(sample[:, : self.half], size), codebook(sample[:, self.half :], size) if sample.shape[1] > 1 else np.zeros((1, 0))]
        noise = np.random.default_rng(SEED + 1).standard_normal(sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        norm = np.linalg.norm(noise, axis=1, keepdims=True)
        twins = least * sample + np.sqrt(1 - least**2) * noise / np.maximum(norm, 1e-12)
        over = np.zeros(len(sample))
        # the home of a twin is the nearest centre of each half, so no cell has to be listed
        for own, other in zip(self.halves(sample), self.halves(twins)):
            over += own[np.arange(len(own)), other.argmin(axis=1)] - own.min(axis=1)
        self.margin = float(np.quantile(over, recall)) + 1e-9

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the two halves of every row to their centres."""
        return squared_distances(rows[:, : self.half], self.books[0]), squared_distances(rows[:, self.half :], self.books[1])

    def visits(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The home cell of each row, and the cells it visits within the margin, home among them."""
        first, second = self.halves(rows)
        wide = len(self.books[1])
        home, out = first.argmin(axis=1) * wide + second.argmin(axis=1), []
        order_a, order_b = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
        for k in range(len(rows)):
            a, b = first[k, order_a[k]], second[k, order_b[k]]
            limit = a[0] + b[0] + self.margin
            n = np.searchsorted(b, limit - a[: np.searchsorted(a, limit - b[0], "right")], "right")
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.repeat(order_a[k, : len(n)], n) * wide + order_b[k, inside])
        return home, out


def grid_size(rows: int) -> int:
    """Centres of a half, so that a cell holds a few dozen of the rows that may meet."""
    return int(min(max(2 ** round(np.log2(max(rows / PER_CELL, 1)) / 2), 2), 1024))


def route(classes: DataFrame, grid: Grid, wide: bool) -> DataFrame:
    """(label, cell, rid, m, vec, base, home, seen): each class once at home (base), with the cells it
    visits (`seen`), and once for every visit."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "rid", "m", "vec", "cell", "base", "home", "seen"]
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                home, visits = grid.visits(unit_rows(batch.column("vec").to_pylist(), wide))
                who = np.repeat(np.arange(len(home)), [len(v) for v in visits])
                seen = pa.array([np.sort(v).astype(np.int64).tobytes() for v in visits], pa.binary())
                for rows, cells, base in ((np.arange(len(home)), home, True), (who, np.concatenate([*visits, np.empty(0, dtype=np.int64)]), False)):
                    out = batch.select(["label", "rid", "m", "vec"]).take(pa.array(rows))
                    more = [pa.array(cells.astype(np.int64)), pa.array(np.full(len(rows), base)), pa.array(home[rows].astype(np.int64)), seen if base else pa.nulls(len(rows), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*out.columns, *more], names)

    return classes.select("label", "rid", "m", "vec").mapInArrow(
        send, "label string, rid long, m long, vec binary, cell long, base boolean, home long, seen binary"
    )


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row (left) and column (right) of a link matrix can reach."""
    a, b = left.copy(), right.copy()
    i, j = np.nonzero(linked)
    while True:
        low = np.minimum(a[i], b[j])
        before = (a.copy(), b.copy())
        np.minimum.at(a, i, low)
        np.minimum.at(b, j, low)
        if (a == before[0]).all() and (b == before[1]).all():
            return a, b


def tile_links(routed: DataFrame, least: float, wide: bool, tile: int) -> DataFrame:
    """(rid, to, n): links of each class that a tile counts (n, with copies), and forest edges."""

    def compare(key, base: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(query):
            return pd.DataFrame({"rid": [], "to": [], "n": []}).astype("int64")
        b, q = base["rid"].to_numpy(), query["q_rid"].to_numpy()
        linked = unit_rows(list(query["q_vec"]), wide) @ unit_rows(list(base["vec"]), wide).T >= least
        linked &= q[:, None] != b[None, :]
        # found at the other home as well: counted where the smaller one asks
        counts, home = linked.copy(), query["q_home"].to_numpy()
        for k in np.flatnonzero(linked.any(axis=0)):
            both = np.isin(home, np.frombuffer(base["seen"].iat[k], dtype=np.int64))
            counts[:, k] &= ~both | (q < b[k])
        to_q, to_b = forest(linked, q, b)
        n = np.concatenate([counts @ base["m"].to_numpy(), query["q_m"].to_numpy() @ counts])
        out = pd.DataFrame({"rid": np.concatenate([q, b]), "to": np.concatenate([to_q, to_b]), "n": n})
        return out[(out["n"] > 0) | (out["to"] < out["rid"])]

    sizes = counted(
        routed.groupBy("label", "cell").agg(
            F.ceil(F.sum(F.col("base").cast("long")) / tile).alias("nb"), F.ceil(F.sum((~F.col("base")).cast("long")) / tile).alias("nq")
        ).where("nb > 0 and nq > 0")
    )
    rows = routed.join(sizes, ["label", "cell"])
    mine = lambda n: F.pmod(F.xxhash64("rid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    base = rows.where("base").select("label", "cell", "rid", "m", "vec", "seen", mine("nb").alias("tb"), every("nq").alias("tq"))
    # other names, as both sides come from one table
    query = rows.where("not base").select(
        F.col("label").alias("q_label"), F.col("cell").alias("q_cell"), F.col("rid").alias("q_rid"), F.col("vec").alias("q_vec"),
        F.col("m").alias("q_m"), F.col("home").alias("q_home"),
        mine("nq").alias("q_tq"), every("nb").alias("q_tb"),
    )
    return base.groupBy("label", "cell", "tb", "tq").cogroup(query.groupBy("q_label", "q_cell", "q_tb", "q_tq")).applyInPandas(compare, "rid long, to long, n long")


def vector_duplicates(
    vectors: DataFrame, least: float = LEAST_COSINE, recall: float = RECALL, sample: int = SAMPLE, tile: int = TILE
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    vectors = with_missing(vectors, vec_id="long", embedding="array<double>", label="string")
    element = vectors.schema["embedding"].dataType.elementType
    wide = not isinstance(element, T.FloatType)
    plain = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"),
    )
    rows = cut_lineage(packed(plain, wide))
    classes = cut_lineage(
        rows.where("vec is not null and vec_id is not null").groupBy("label", "dim", "k1", "k2").agg(
            F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("m"), F.max("vec").alias("vec")
        )
    )
    per_dim = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("most")).collect()
    parts = []
    for row in per_dim:  # one length, as a rule
        own = classes.where(F.col("dim") == row["dim"])
        drawn = own.orderBy(F.xxhash64("k1"), "k2").limit(sample).select("vec").collect()
        grid = Grid(unit_rows([bytes(r["vec"]) for r in drawn], wide), grid_size(row["most"]), least, recall)
        parts.append(tile_links(cut_lineage(route(own, grid, wide)), least, wide, tile))
    if not parts:
        links = rows.sparkSession.createDataFrame([], "rid long, to long, n long")
    else:
        links = parts[0]
        for more in parts[1:]:
            links = links.unionByName(more)
    links = cut_lineage(links)
    groups = connected_components(links.where("`to` < rid").select(F.col("to").alias("src"), F.col("rid").alias("dst")))
    totals = links.groupBy("rid").agg(F.sum("n").alias("n"))
    # written, so that the join below shuffles both its sides itself and can split a hot class
    named = cut_lineage(
        classes.select("label", "k1", "k2", "rid", "m")
        .join(totals, "rid", "left")
        .join(groups.select(F.col("id").alias("rid"), "component"), "rid", "left")
        .select(
            "label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component")
        )
    )
    out = rows.select("vec_id", "label", "k1", "k2").join(named, ["label", "k1", "k2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
