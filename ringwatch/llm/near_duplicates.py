"""Near-duplicate documents by a chosen-path set similarity join on minhash signatures.

A document is the set of its word shingles, reduced to a signature of minwise tokens. Documents
with equal sets are one class from the start. Each of several independent trees sends every class
down the minwise tokens that its node selects (a node picks token places by a hash of its own
name, 1 / similarity of them on average, as in CPSJoin by Christiani, Pagh and Sivertsen 2017).
Small nodes are compared exhaustively on signatures, larger ones branch again, several tokens at a
step.

Only the groups of linked classes are wanted, so large groups of near copies are contracted: at every
step the classes of large nodes are paired with their nodes' pivots, the pair that looks nearest
is confirmed on full sets, and what these connect is a group. A node whose classes all belong to
one group is finished, and pairs inside a group are never made, so a group costs a few rows for each of its
classes and not for each of its pairs. No class leaves a node that holds another group: a node is
compared at once when the pairs between its groups are few for each of its classes (a large group and
some others, or some hundred classes), which is less work than to send the classes on; else it
branches with all its classes. What is still large after LEVELS steps is compared by blocks.

Candidates are confirmed on full sets. First each class with its most similar partner; then, of
the candidates that would join two different groups, all of them. Components are those of confirmed
links. Contraction only saves work: a pair it does not confirm is still met in the trees.

A pair at the limit keeps more than one expected copy at every level of a tree: a level sends it
down 1.25 / s^length paths of that length. By this branching the default of 10 trees brings 9,997 of
10,000 such pairs together behind three large levels, and 9,995 behind four.

Edge cases: documents without words or text have the empty set and link with nothing; texts of
fewer words than a shingle are one shingle. Rows without doc_id are returned with a null
component and kept. Rows that repeat a doc_id are compared by their texts; a class is named by
its smallest doc_id, and classes of the same name are one.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import counted, replacing, with_missing
from ringwatch.operators.components import connected_components
from ringwatch.session import cut_lineage, let_go

WIDTH = 5
SIMILARITY = 0.8
PLACES = 96
TREES = 10
LEAF = 48
MARGIN = 0.15
NEAR = 0.75
STEP = 6
SPARE = 1.25
LEVELS = 6
#: a contracted node is compared at once up to that many leaves of pairs between groups for each class
LEAVES = 10
#: times that the classes of large nodes meet other pivots of their nodes before they are compared
TURNS = 3
#: classes that a node compared at once may have, if its pairs between groups are few for each of them
DIRECT = 16_384
BLOCK = 512
#: sets of each side of a block in which pairs are confirmed
BLOCK_SETS = 256
BROADCAST_IDS = 1_000_000
BROADCAST_PIVOTS = 20_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Hashes of words seen so far; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingle_set(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words split at ASCII spaces, A-Z lowered."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n, w = max(len(h) - width + 1, 1), min(width, len(h))
    out = np.full(n, w, dtype=np.uint64)
    for place in range(w):
        out = mixed(out * _ODD + h[place : place + n])
    return np.unique(out)


def signature(shingles: np.ndarray, places: int) -> np.ndarray:
    """For each place the smallest of the set's hashes under that place's scramble (32 bits)."""
    factors = mixed(np.arange(1, places + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    best = np.full(places, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[start : start + 1024, None] * factors[None, :]
        best = np.minimum(best, (part ^ (part >> np.uint64(30))).min(axis=0))
    return (mixed(best) >> np.uint64(32)).astype(np.uint32)


def document_signatures(docs: DataFrame, width: int = WIDTH, places: int = PLACES) -> DataFrame:
    """(doc_id, n, k1, k2, sig): the size of the set, its 128-bit name and its signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), width, words)
                name = xxhash.xxh3_128_digest(found.tobytes())
                n.append(len(found))
                k1.append(int.from_bytes(name[:8], "big", signed=True))
                k2.append(int.from_bytes(name[8:], "big", signed=True))
                sig.append(signature(found, places).tobytes() if len(found) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n, k1, k2)), pa.array(sig, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        sign, "doc_id long, n long, k1 long, k2 long, sig binary"
    )


def picks(node: int, places: int, similarity: float) -> list[int]:
    """The token places a root branches on: one, and each other with the chance that makes 1 / similarity."""
    draw = mixed(np.arange(places, dtype=np.uint64) * _ODD ^ mixed(np.array([node & (2**64 - 1)], dtype=np.uint64)))
    extra = (draw >> np.uint64(11)).astype(np.float64) / 2**53 < (1 / similarity - 1) / places
    extra[int(np.argmin(draw))] = True
    return np.flatnonzero(extra).tolist()


def paths(node: int, places: int, similarity: float) -> list[np.ndarray]:
    """The paths of several token places down which a large node sends its classes in one step.

    A path is so long that classes of little similarity end in small nodes, at every level alike.
    There are SPARE * similarity ** -length paths, so that of a pair at the limit more than one
    copy is expected to go on, however many levels it has to pass.
    """
    length = min(STEP, places)
    out = []
    for j in range(int(np.ceil(SPARE * similarity**-length))):
        seed = mixed(np.array([(node + j * 0x9E3779B97F4A7C15) & (2**64 - 1)], dtype=np.uint64))
        out.append(np.argsort(mixed(np.arange(places, dtype=np.uint64) * _ODD ^ seed))[:length])
    return out


def path_ends(node: int, path: np.ndarray, j: int, sig: np.ndarray) -> np.ndarray:
    """The node at the end of a path for each signature."""
    out = np.repeat(np.array([(node + (j + 1) * 0xBF58476D1CE4E5B9) & (2**64 - 1)], dtype=np.uint64), len(sig))
    for place in path.tolist():
        out = mixed(out ^ sig[:, place].astype(np.uint64) * _ODD)
    return mixed(out).view(np.int64)


def child_names(node: np.ndarray, place: int, token: np.ndarray) -> np.ndarray:
    own = np.array([place + 1], dtype=np.uint64) * _MIX
    return mixed(mixed(node + own) ^ token.astype(np.uint64) * _ODD).view(np.int64)


def signatures_of(column: pa.Array, places: int) -> np.ndarray:
    rows = b"".join(column.to_pylist())
    return np.frombuffer(rows, dtype=np.uint32).reshape(-1, places)


def plant_trees(classes: DataFrame, trees: int, places: int, similarity: float) -> DataFrame:
    """(node, rid): every class under the nodes of the first level of every tree."""
    roots = [(mixed(np.array([t + 1], dtype=np.uint64) * _MIX), t) for t in range(trees)]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig, rid = signatures_of(batch.column("sig"), places), batch.column("rid")
                for root, _ in roots:
                    for place in picks(int(root[0]), places, similarity):
                        nodes = child_names(np.repeat(root, len(sig)), place, sig[:, place])
                        yield pa.RecordBatch.from_arrays([pa.array(nodes), rid], ["node", "rid"])

    return classes.select("rid", "sig").mapInArrow(plant, "node long, rid long")


def _estimated(rid: np.ndarray, group: np.ndarray, sig: np.ndarray, least: float, own: np.ndarray | None = None) -> Iterator[tuple]:
    """(a, b, est) of the pairs between different groups whose signatures agree in a share of at least `least`.

    The largest group is compared with the others, and these with each other. With `own`, a mark
    of two sides, pairs are those across the sides.
    """
    if own is None:
        names, inverse, n = np.unique(group, return_inverse=True, return_counts=True)
        rest = inverse != int(np.argmax(n))
    else:
        rest = own
    order = np.argsort(~rest, kind="stable")
    rid, group, sig = rid[order], group[order], sig[order]
    m = int(rest.sum())
    for i in range(m):
        lo = i + 1 if own is None else m
        est = (sig[lo:] == sig[i]).mean(axis=1)
        j = np.flatnonzero((est >= least) & (group[lo:] != group[i])) + lo
        if len(j):
            yield np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j]), est[j - lo]


def _pair_batches(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in found:
        held.append(part)
        size += len(part[0])
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["a", "b", "est"])
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["a", "b", "est"])


def exhaustive_pairs(members: DataFrame, places: int, least: float) -> DataFrame:
    """(a, b, est): the pairs of each node between groups that are estimated near.

    `members` (node, rid, grp, sig) come sorted by node within partitions; a node has at most
    DIRECT classes, and pairs between groups in proportion to them.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes() -> Iterator[tuple[np.ndarray, ...]]:
            rest = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                now = (*(batch.column(c).to_numpy() for c in ("node", "rid", "grp")), signatures_of(batch.column("sig"), places))
                if rest is not None:
                    now = tuple(np.concatenate(x) for x in zip(rest, now))
                cuts = np.flatnonzero(np.diff(now[0])) + 1
                for lo, hi in itertools.pairwise([0, *cuts.tolist()]):
                    yield tuple(x[lo:hi] for x in now[1:])
                last = int(cuts[-1]) if len(cuts) else 0
                rest = tuple(x[last:] for x in now)
            if rest is not None:
                yield rest[1:]

        yield from _pair_batches(pair for node in nodes() for pair in _estimated(*node, least))

    return members.select("node", "rid", "grp", "sig").mapInArrow(compare, "a long, b long, est double").where("a < b")


def block_pairs(members: DataFrame, sizes: DataFrame, places: int, least: float) -> DataFrame:
    """(a, b, est): the same of nodes of any size, block against block."""

    def across(rows: pa.Table) -> pa.Table:
        a, b, own = rows.column("_a")[0].as_py(), rows.column("_b")[0].as_py(), rows.column("_own").to_numpy()
        columns = (rows.column("rid").to_numpy(), rows.column("grp").to_numpy(), signatures_of(rows.column("sig"), places))
        found = list(_pair_batches(_estimated(*columns, least, None if a == b else own == a)))
        return pa.Table.from_batches(found, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("est", pa.float64())]))

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = members.select("node", "rid", "grp", "sig").join(sizes.select("node", blocks.alias("_n")), "node")
    spread = spread.withColumn("_own", F.pmod(F.xxhash64("rid"), "_n").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    spread = spread.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")}).drop("_n", "_other")
    return spread.groupBy("node", "_a", "_b").applyInArrow(across, "a long, b long, est double").where("a < b")


def branches(members: DataFrame, places: int, similarity: float) -> DataFrame:
    """(node, rid, grp): the classes of large nodes at the ends of their node's paths."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, rid, grp = (batch.column(c).to_numpy() for c in ("node", "rid", "grp"))
            sig = signatures_of(batch.column("sig"), places)
            on = np.argsort(node, kind="stable")
            for mine in np.split(on, np.flatnonzero(np.diff(node[on])) + 1):
                name = int(node[mine[0]])
                for j, path in enumerate(paths(name, places, similarity)):
                    columns = (path_ends(name, path, j, sig[mine]), rid[mine], grp[mine])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["node", "rid", "grp"])

    return members.select("node", "rid", "grp", "sig").mapInArrow(branch, "node long, rid long, grp long")


def settle(rows: DataFrame, leaf: int, leaves: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of the nodes of two, the members (node, rid, grp, large) of the other nodes, and
    the large nodes (node, n).

    A node is large beyond a leaf, but not with at most `leaves` leaves of pairs between groups for each
    class. Nodes of one group are finished. A node that holds the same classes as another one that
    is compared at once is compared once.
    """
    per_group = rows.groupBy("node", "grp").agg(
        F.count(F.lit(1)).alias("c"), F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.bit_xor(F.xxhash64("rid")).alias("x")
    )
    nodes = cut_lineage(
        per_group.groupBy("node")
        .agg(
            F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("inside"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.bit_xor("x").alias("x"), F.min("grp").alias("g0"), F.max("grp").alias("g1"),
        )
        .where("g0 < g1")
    )
    pairs = nodes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    # so pairs stay in proportion to classes
    between = F.col("n") * F.col("n") - F.col("inside")
    few = (F.col("n") <= leaf) | ((F.col("n") <= DIRECT) & (between <= leaves * leaf * F.col("n")))
    small = nodes.where((F.col("n") > 2) & few).groupBy("n", "lo", "hi", "x").agg(F.min("node").alias("node"))
    large = nodes.where((F.col("n") > 2) & ~few).select("node", "n")
    wanted = small.select("node", F.lit(False).alias("large")).unionByName(large.select("node", F.lit(True).alias("large")))
    return pairs, cut_lineage(rows.join(wanted, "node")), large


def pairs_with_pivots(rows: DataFrame, classes: DataFrame, places: int, least: float, turn: int = 0) -> DataFrame:
    """(a, b, est): every class with the pivot of one of its nodes, where it looks nearest, if that is near.

    `rows` (node, rid, grp) are members of large nodes; a pivot of the own group is passed over.
    Each turn has pivots of its own.
    """
    pivots = rows.groupBy("node").agg(F.min_by(F.struct("rid", "grp"), F.xxhash64("rid", "node", F.lit(turn))).alias("p"))
    sig_of = lambda key, name: classes.select(F.col("rid").alias(key), F.col("sig").alias(name))
    # counted few pivots go to the classes with their signatures, so that no pair of signatures is shuffled
    pivots = pivots.select("node", F.col("p.rid").alias("pivot"), F.col("p.grp").alias("other")).join(sig_of("pivot", "sb"), "pivot")
    own = rows.join(sig_of("rid", "sa"), "rid").join(counted(pivots, BROADCAST_PIVOTS), "node").where("grp <> other")
    near = cut_lineage(two_of_a_kind(own.select(F.col("rid").alias("a"), F.col("pivot").alias("b"), "sa", "sb"), places, least))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "est")
    both = near.select("a", "b", "est", F.explode(F.array("a", "b")).alias("v"))
    best = both.groupBy("v").agg(F.max_by(F.struct("a", "b", "est"), F.struct("est", -F.col("a"), -F.col("b"))).alias("p"))
    return best.select("p.a", "p.b", "p.est").distinct()


def with_signatures(pairs: DataFrame, classes: DataFrame, places: int, least: float) -> DataFrame:
    side = lambda key, name: classes.select(F.col("rid").alias(key), F.col("sig").alias(name))
    return two_of_a_kind(pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b"), places, least)


def grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, rid, grp): the rows under the groups as they are now."""
    known = groups.select(F.col("id").alias("rid"), "component")
    return cut_lineage(rows.select("node", "rid").join(known, "rid", "left").select("node", "rid", F.coalesce("component", "rid").alias("grp")))


def chosen_path_pairs(
    docs: DataFrame, classes: DataFrame, width: int, percent: int, trees: int = TREES, places: int = PLACES, leaf: int = LEAF
) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, est) of classes (rid, sig) from all trees, a < b, and the groups (id, component)
    that were contracted on the way; candidates lay in different groups when they were made."""
    similarity = percent / 100
    least, sigs = similarity - MARGIN, classes.select("rid", "sig")
    groups = docs.sparkSession.createDataFrame([], "id long, component long")
    rows = cut_lineage(plant_trees(classes, trees, places, similarity).distinct().withColumn("grp", F.col("rid")))
    found, twos = [], []

    def compare_small(rows: DataFrame, leaves: int) -> tuple[DataFrame, DataFrame]:
        """The members (node, rid, grp) of the nodes that are large, and these nodes."""
        nonlocal sigs
        pairs, members, large = settle(rows, leaf, leaves)
        twos.append(pairs)
        # deeper nodes hold some of these classes and no others, so only their signatures move on
        sigs = cut_lineage(sigs.join(members.select("rid").distinct(), "rid", "left_semi"))
        with_sig = members.where("not large").drop("large").join(sigs, "rid").repartition("node").sortWithinPartitions("node", "rid")
        found.append(exhaustive_pairs(with_sig, places, least))
        return members.where("large").drop("large"), large

    for level in range(LEVELS + 1):
        # only nodes beyond a leaf are contracted
        rows, large = compare_small(rows, 0)
        if large.isEmpty():
            break
        # a group that lies in parts has as many pairs between its parts as it has inside them
        for turn in range(TURNS):
            before, groups = groups, contracted(docs, classes, rows, groups, width, percent, places, turn)
            if groups is before:
                break
            rows = grouped(rows, groups)
            let_go(docs.sparkSession)
        rows, large = compare_small(rows, LEAVES)
        if large.isEmpty():
            break
        on = rows.join(sigs, "rid")
        if level == LEVELS:
            found.append(block_pairs(on, large, places, least))
            break
        rows = cut_lineage(branches(on, places, similarity).distinct())
        let_go(docs.sparkSession)
    two = twos[0]
    for more in twos[1:]:
        two = two.unionByName(more)
    # a pair is a node of two
    found.append(with_signatures(two.distinct(), classes, places, least))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("a", "b").agg(F.max("est").alias("est")), groups


def two_of_a_kind(pairs: DataFrame, places: int, least: float) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                est = (signatures_of(batch.column("sa"), places) == signatures_of(batch.column("sb"), places)).mean(axis=1)
                rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], ["a", "b", "est"])
                yield rows.filter(pa.array(est >= least))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, est double")


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(rid, shingles): the full sets of the documents named by `ids`, one per id."""
    schema = pa.schema([("rid", pa.int64()), ("shingles", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], schema=schema)

    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = texts.join(ids.withColumnRenamed("rid", "doc_id"), "doc_id", "left_semi")
    return wanted.mapInArrow(cut, "rid long, shingles binary").groupBy("rid").agg(F.min("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): the pairs whose full sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb")):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    side = lambda key, name: sets.select(F.col("rid").alias(key), F.col("shingles").alias(name))
    return pairs.select("a", "b").join(side("a", "xa"), "a").join(side("b", "xb"), "b").select("a", "b", "xa", "xb").mapInArrow(
        check, "src long, dst long"
    )


def confirmed_in_blocks(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): the same, for pairs that name the same classes many times.

    Pairs are dealt to blocks by both their ends, and a set goes once to each block that has a
    pair of it: at most once for every pair, and far less where a class has many pairs.
    """
    n = sets.select(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("n")).first()["n"]
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, n))).alias(f"_{c}")
    dealt = pairs.select("a", "b", side("a"), side("b"))
    ends = dealt.select("_a", "_b", F.explode(F.array("a", "b")).alias("rid")).distinct().join(sets, "rid")
    # renamed, as both sides of the cogroup come from the same pairs
    ends = ends.select(F.col("_a").alias("_c"), F.col("_b").alias("_d"), "rid", "shingles")

    def check(here: pa.Table, own: pa.Table) -> pa.Table:
        held = {r: np.frombuffer(x.as_py(), dtype=np.uint64) for r, x in zip(own.column("rid").to_pylist(), own.column("shingles"))}
        keep = []
        for a, b in zip(here.column("a").to_pylist(), here.column("b").to_pylist()):
            x, y = held.get(a), held.get(b)
            both = 0 if x is None or y is None else len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        return here.select(["a", "b"]).rename_columns(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return dealt.groupBy("_a", "_b").cogroup(ends.groupBy("_c", "_d")).applyInArrow(check, "src long, dst long")


def joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the groups after links (src, dst) between classes of different groups."""
    if links.isEmpty():
        return groups
    group_of = lambda key, name: groups.select(F.col("id").alias(key), F.col("component").alias(name))
    # the groups found so far are the nodes of a much smaller graph
    between = (
        links.join(group_of("src", "ga"), "src", "left")
        .join(group_of("dst", "gb"), "dst", "left")
        .select(F.coalesce("ga", "src").alias("src"), F.coalesce("gb", "dst").alias("dst"))
    )
    merged = connected_components(between).select(F.col("id").alias("component"), F.col("component").alias("final"))
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    alone = ends.join(groups, "id", "left_anti").select("id", F.col("id").alias("component"))
    out = groups.unionByName(alone).join(merged, "component", "left")
    return cut_lineage(out.select("id", F.coalesce("final", "component").alias("component")))


def contracted(
    docs: DataFrame, classes: DataFrame, rows: DataFrame, groups: DataFrame, width: int, percent: int, places: int, turn: int = 0
) -> DataFrame:
    """(id, component): the groups, with those joined that confirmed links to pivots of large nodes connect."""
    near = cut_lineage(pairs_with_pivots(rows, classes, places, NEAR, turn))
    if near.isEmpty():
        return groups
    ids = near.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    links = cut_lineage(confirmed(near, cut_lineage(shingle_sets(docs, ids, width)), percent))
    return joined_groups(groups, links)


def linked_groups(docs: DataFrame, candidates: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, component) of the classes with a confirmed link, from groups of some of them."""
    ids = cut_lineage(candidates.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
    sets = cut_lineage(shingle_sets(docs, ids, width))
    both = candidates.select("a", "b", "est", F.explode(F.array("a", "b")).alias("v"))
    best = both.groupBy("v").agg(F.max_by(F.struct("a", "b"), F.struct("est", -F.col("a"), -F.col("b"))).alias("p"))
    first = best.select("p.a", "p.b").distinct()
    groups = joined_groups(groups, cut_lineage(confirmed(first, sets, percent)))
    group_of = lambda key, name: groups.select(F.col("id").alias(key), F.col("component").alias(name))
    apart = (
        candidates.select("a", "b")
        .join(group_of("a", "ga"), "a", "left")
        .join(group_of("b", "gb"), "b", "left")
        .where(F.coalesce("ga", "a") != F.coalesce("gb", "b"))
        .select("a", "b")
        .join(first, ["a", "b"], "left_anti")
    )
    return joined_groups(groups, cut_lineage(confirmed_in_blocks(apart, sets, percent)))


def near_duplicate_groups(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = int(100 * SIMILARITY),
    trees: int = TREES,
    places: int = PLACES,
    leaf: int = LEAF,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id of the group), kept."""
    docs = with_missing(docs, doc_id="long", text="string").select("doc_id", "text")
    signed = cut_lineage(document_signatures(docs, width, places))
    classes = cut_lineage(
        signed.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select(
            "k1", "k2", F.col("r.doc_id").alias("rid"), F.col("r.sig").alias("sig")
        )
    )
    candidates, groups = chosen_path_pairs(docs, classes, width, percent, trees, places, leaf)
    groups = linked_groups(docs, cut_lineage(candidates), groups, width, percent)
    # written, so that the join below shuffles both its sides itself and can split a hot class
    named = cut_lineage(
        classes.select("k1", "k2", "rid")
        .join(groups.select(F.col("id").alias("rid"), "component"), "rid", "left")
        .select("k1", "k2", F.coalesce("component", "rid").alias("component"))
    )
    out = signed.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without near copies: of each group the document with the smallest doc_id stays.

    Rows without doc_id stay. Of rows that repeat a doc_id one stays, the one with the smallest text.
    """
    docs = replacing(with_missing(docs, doc_id="long", text="string"), "_k")
    groups = cut_lineage(near_duplicate_groups(docs, **options))
    gone = counted(groups.where(~F.col("kept")).select("doc_id").distinct(), BROADCAST_IDS)
    rest = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = counted(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), BROADCAST_IDS)
    if again.isEmpty():
        return rest
    row = F.struct(F.col("text"), *[F.to_json(F.struct(F.col(f"`{c}`"))).alias(f"_{i}") for i, c in enumerate(docs.columns)])
    firsts = rest.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), row).alias("_k"))
    return rest.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(firsts.select(*[F.col("_k")[c].alias(c) for c in docs.columns]))
