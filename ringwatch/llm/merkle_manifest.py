"""A Merkle manifest of a table of documents, and proofs that a document belongs to it.

A leaf is the SHA-256 of a row's fields. Per source the leaves are put in order, and every 16
neighbours become the digest of their concatenated digests, level by level, until one is left; the
subroots of the sources are folded likewise into the root. The tree is kept as a content-addressed
store: one record (height, digest, children) for each inner node, equal nodes once.

Proofs come from a descent of that store. The frontier begins as the one root. At each height the
nodes of the frontier look up their children by digest, every child that some request needs goes
on under the next digit of its rank, and the other children are collected as the segment of that
height. The frontier ends at runs of 16 leaves, so what lies above a run is carried once for the
run and not once per leaf, and the leaves join it by run. A leaf's own segment and the collected
ones, reversed, are its proof. Everything is shuffled by run or digest; no key of a source is.

Edge cases: null fields are `-`; rows without doc_id come first in their source; rows of equal
doc_id are ordered by their leaf, equal rows are leaves of their own; a lone leaf is its subroot
and a lone subroot is the root, with empty proofs. A table without rows has no root (None) and no
proofs. Columns other than doc_id, source, lang, n_chars and text are not read.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import lower_ascii, ranked, with_missing
from ringwatch.session import cut_lineage

FANOUT = 16
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}


def leaf_digest(**fields: Column) -> Column:
    """SHA-256 of the fields in the order of FIELDS: `-` if null, else UTF-8 byte count, `:`, value."""
    parts = []
    for name in FIELDS:
        value = fields.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold nodes (tree, pos, digest, n) of any number of trees, n being the size of the tree.

    Gives the store (height, digest, children) and the roots (tree, digest, height).
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    records, roots, height = [], [], 0
    while True:
        roots.append(nodes.where("n = 1").select("tree", "digest", F.lit(height).alias("height")))
        if most <= 1:
            break
        most, height = -(-most // FANOUT), height + 1
        run = F.floor(F.col("pos") / FANOUT).cast("long")
        children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda c: c["digest"])
        made = cut_lineage(
            nodes.where("n > 1")
            .groupBy("tree", run.alias("pos"))
            .agg(children.alias("children"), F.first("n").alias("n"))
            .select("tree", "pos", F.sha2(F.array_join("children", ""), 256).alias("digest"), "children", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"))
        )
        records.append(made.select(F.lit(height).alias("height"), "digest", "children"))
        nodes = made.select("tree", "pos", "digest", "n")
    empty = nodes.sparkSession.createDataFrame([], "height int, digest string, children array<string>")
    store = empty
    for level in records:
        store = store.unionByName(level)
    all_roots = roots[0]
    for level in roots[1:]:
        all_roots = all_roots.unionByName(level)
    return store.dropDuplicates(["height", "digest"]), cut_lineage(all_roots)


@dataclass
class Manifest:
    """The store, the sources (source, tree, subroot, height, n), the ranked leaves (those of the
    table with tree and rank) and the root with its height over the subroots."""

    store: DataFrame
    sources: DataFrame
    leaves: DataFrame
    root: str | None
    height: int


def build_manifest(leaves: DataFrame) -> Manifest:
    """The manifest of `leaves` (source, doc_id, leaf and any other narrow columns)."""
    placed = cut_lineage(ranked(leaves, ["source"], ["doc_id", "leaf"]))
    per_source = placed.groupBy("source").agg(F.max("n").alias("size"))
    trees = cut_lineage(ranked(per_source, [], ["source"]).select("source", "size", F.col("rank").alias("tree"), F.col("n").alias("n_trees")))
    named = trees.select(F.col("source").alias("_s"), "tree")
    placed = cut_lineage(placed.join(F.broadcast(named) if named.count() <= 100_000 else named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    store, subroots = folded(placed.select("tree", F.col("rank").alias("pos"), F.col("leaf").alias("digest"), "n"))
    sources = cut_lineage(trees.join(subroots, "tree").select("source", "tree", F.col("digest").alias("subroot"), "height", F.col("size").alias("n"), "n_trees"))
    top = sources.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"), F.col("n_trees").alias("n"))
    upper, root = folded(top)
    found = root.first()
    # heights of the upper tree are counted on from below zero, so both live in one store
    store = store.unionByName(upper.withColumn("height", -F.col("height")))
    return Manifest(cut_lineage(store), sources.drop("n_trees"), placed, found and found["digest"], found["height"] if found else 0)


def step(frontier: DataFrame, store: DataFrame, height: int) -> DataFrame:
    """One digit further down: a row per child, the others collected in its segment."""
    records = store.where(F.col("height") == height).select(F.col("digest").alias("_d"), "children")
    at, kids = F.col("_i"), F.col("children")
    segment = F.struct(F.slice(kids, F.lit(1), at).alias("left"), F.slice(kids, at + 2, F.size(kids)).alias("right"))
    kept = [c for c in frontier.columns if c not in ("prefix", "digest", "segments")]
    return (
        frontier.join(records, F.col("digest") == F.col("_d"))
        .select("*", F.posexplode("children").alias("_i", "_child"))
        .select(*kept, (F.col("prefix") * FANOUT + at).alias("prefix"), F.col("_child").alias("digest"), F.concat("segments", F.array(segment)).alias("segments"))
    )


def descend(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """A row per requested run: tree, run (rank / 16), segments from the root down to the run, and `children`.

    `requests` holds (tree, rank). Nodes under which nothing is requested leave the frontier.
    """
    spark = requests.sparkSession
    segments = "array<struct<left:array<string>,right:array<string>>>"
    frontier = spark.createDataFrame([(0, manifest.root, [])], f"prefix long, digest string, segments {segments}")
    asked = cut_lineage(requests.select("tree", F.floor(F.col("rank") / FANOUT).cast("long").alias("run")).distinct())
    trees = asked.select("tree").distinct()
    for height in range(manifest.height, 0, -1):
        frontier = step(frontier, manifest.store, -height)
        below = F.floor(F.col("tree") / FANOUT ** (height - 1)).cast("long")
        frontier = frontier.join(trees.select(below.alias("prefix")).distinct(), "prefix", "left_semi")
    frontier = cut_lineage(
        frontier.select(F.col("prefix").alias("tree"), "digest", "segments")
        .join(manifest.sources.select("tree", "height"), "tree")
        .withColumn("prefix", F.lit(0).cast("long"))
    )
    highest = frontier.agg(F.max("height")).first()[0] or 0
    for height in range(highest, 1, -1):
        wait = frontier.where(F.col("height") < height)
        moved = step(frontier.where(F.col("height") >= height), manifest.store, height)
        below = F.floor(F.col("run") / FANOUT ** (height - 2)).cast("long")
        moved = moved.join(asked.select("tree", below.alias("prefix")).distinct(), ["tree", "prefix"], "left_semi")
        frontier = cut_lineage(wait.unionByName(moved.select(*wait.columns)))
    runs = manifest.store.where("height = 1").select(F.col("digest").alias("_d"), "children")
    lone = F.when(F.col("height") == 0, F.array("digest"))
    return frontier.join(runs, (F.col("digest") == F.col("_d")) & (F.col("height") > 0), "left").select(
        "tree", F.col("prefix").alias("run"), "segments", "height", F.coalesce("children", lone).alias("children")
    )


def folded_up(start: Column, proof: Column) -> Column:
    """The digest that a leaf and its proof (segments from the leaf up) come to."""
    return F.aggregate(
        proof, start, lambda at, s: F.sha2(F.concat(F.array_join(s["left"], ""), at, F.array_join(s["right"], "")), 256)
    )


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The rows of `requests` (tree, rank and others) with `proof`, segments from the leaf up to the root."""
    if manifest.root is None:
        return requests.withColumn("proof", F.array().cast("array<struct<left:array<string>,right:array<string>>>"))
    runs = descend(manifest, requests)
    run = F.floor(F.col("rank") / FANOUT).cast("long")
    grouped = requests.groupBy("tree", run.alias("run")).agg(F.collect_list(F.struct(*requests.columns)).alias("_rows"))
    at, kids = F.pmod(F.col("_row.rank"), F.lit(FANOUT)).cast("int"), F.col("children")
    own = F.array(F.struct(F.slice(kids, F.lit(1), at).alias("left"), F.slice(kids, at + 2, F.size(kids)).alias("right")))
    path = F.when(F.col("height") > 0, F.concat("segments", own)).otherwise(F.col("segments"))
    return grouped.join(runs, ["tree", "run"]).select("*", F.explode("_rows").alias("_row")).select("_row.*", F.reverse(path).alias("proof"))


def proof_digests(proof: Column) -> Column:
    """All siblings of a proof, from the leaf up, left to right."""
    return F.flatten(F.transform(proof, lambda s: F.concat(s["left"], s["right"])))


def tampered(doc_id: Column) -> Column:
    """Whether the audit alters this document: 5 divides the CRC-32 of its number."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def audited_manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root and proof_sha256 of the table as it is, and folded_root and
    verified of a copy in which the texts of a fifth of the documents are lower-cased."""
    docs = with_missing(docs, **FIELDS).select(*[F.col(c).cast(t).alias(c) for c, t in FIELDS.items()])
    altered = F.when(tampered(F.col("doc_id")), lower_ascii(F.col("text"))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", leaf_digest().alias("leaf"), F.when(tampered(F.col("doc_id")), leaf_digest(text=altered)).alias("given"))
    manifest = build_manifest(leaves)
    asked = manifest.leaves.select("tree", "rank", "doc_id", "leaf", "given")
    subroots = manifest.sources.select("tree", "subroot")
    root = F.lit(manifest.root).cast("string")
    back = folded_up(F.coalesce("given", "leaf"), F.col("proof"))
    # the few sources are written and counted, so they are copied to the tasks only if they are few
    subroots = F.broadcast(subroots) if subroots.count() <= 100_000 else subroots
    return (
        prove(manifest, asked)
        .join(subroots, "tree")
        .select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(F.array_join(proof_digests(F.col("proof")), ""), 256).alias("proof_sha256"), back.alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
