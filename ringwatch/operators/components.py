"""Connected components and rings over edge tables; recovery of planted rings."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ringwatch import constants as K
from ringwatch.operators.running import prefix_sums, text_row_numbers
from ringwatch.operators.skew import HOT_MIN_ROWS, attach, join_counted
from ringwatch.session import cut_lineage


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each pair once, smaller id first, without loops."""
    return (
        edges.where(F.col(src) != F.col(dst))
        .select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
        .distinct()
    )


def flow_graph(transfers: DataFrame, suspicious: Column, sender: str = "sender", receiver: str = "receiver") -> DataFrame:
    """Undirected graph of the suspicious transfers, self-transfers left in as single nodes."""
    kept = transfers.where(suspicious & F.col(sender).isNotNull() & F.col(receiver).isNotNull())
    return kept.select(F.least(sender, receiver).alias("src"), F.greatest(sender, receiver).alias("dst")).distinct()


def is_true(col: Column | str) -> Column:
    return F.lower((F.col(col) if isinstance(col, str) else col).cast("string")) == "true"


def nodes_of(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All ids that appear on either end."""
    return edges.select(F.col(src).alias("id")).union(edges.select(F.col(dst).alias("id"))).distinct()


def _star(pairs: DataFrame, n_pairs: int) -> DataFrame:
    """(u, v) pairs with the smallest neighbour of u, itself included, on every row.

    A root ends up with most of the pairs, so the join spreads hot ids; with too few pairs for
    any id to be hot a window over its pairs does, which moves them once.
    """
    if n_pairs < HOT_MIN_ROWS:
        return pairs.withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), "u"))
    mins = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_w"))
    return attach(pairs, mins, "u", "_w", ["u", "v"], how="inner")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
        edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))
    )
    linked = _star(both, 2 * n).where("v > u").select(F.col("m").alias("src"), F.col("v").alias("dst"))
    return linked.where("src <> dst")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    pairs = _star(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")), n)
    linked = pairs.select(F.col("m").alias("src"), F.explode(F.array("u", "v")).alias("dst"))
    return linked.where("src <> dst").distinct()


def _round(edges: DataFrame, n: int) -> DataFrame:
    linked = _large_star(edges, n)
    if 2 * n >= HOT_MIN_ROWS:
        linked = cut_lineage(linked.distinct())  # the skew check of the second star reads it again
    return cut_lineage(_small_star(linked, n))


def _progress(edges: DataFrame) -> tuple[int, bool]:
    """Number of the edges (smaller id first, each once), and whether they are stars, which no step changes.

    They are when a node that is the larger end of an edge is an end of no other one.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("larger")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("larger")))).alias("e"))
    nodes = ends.groupBy("e.id").agg(F.sum("e.larger").alias("larger"), F.count(F.lit(1)).alias("n"))
    row = nodes.agg(F.sum("larger").alias("n"), F.count_if(F.expr("larger > 0 and n > 1")).alias("apart")).first()
    return row["n"] or 0, row["apart"] == 0


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id each node can reach.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges are stars.
    Every round is written to the shared checkpoint folder, so the plan does not
    grow and a lost executor costs one round at most.
    """
    # written once: the rounds, the node list and any caller that joins the result read it
    given = cut_lineage(edges.select("src", "dst").distinct())
    nodes = nodes_of(given) if nodes is None else nodes.select("id").distinct()
    current = undirected(given)
    n, stars = _progress(current)
    while not stars:
        current = _round(current, n)
        n, stars = _progress(current)
    # every non-root has one edge, to its root
    roots = current.select(F.col("dst").alias("id"), F.col("src").alias("component"))
    return nodes.join(roots, "id", "left").withColumn("component", F.coalesce("component", "id"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def with_ring_numbers(sized: DataFrame, min_size: int = K.MIN_RING) -> DataFrame:
    """Number the rings by size, largest first, ties by smallest member.

    The number of a ring is the number of larger rings plus its place among rings of its size.
    Many rings share the small sizes, so both parts are running totals over bins.
    """
    rings = cut_lineage(sized.where(F.col("size") >= min_size))
    per_size = rings.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    offsets = prefix_sums(per_size, [], "size", ["n"], ascending=False).select("size", "n_before")
    if isinstance(rings.schema["component"].dataType, StringType):
        placed = text_row_numbers(rings, ["size"], "component", "_one_before")
    else:
        placed = prefix_sums(rings.withColumn("_one", F.lit(1)), ["size"], "component", ["_one"])
    return join_counted(placed, offsets, ["size"]).select(
        "component", "size", (F.col("n_before") + F.col("_one_before") + 1).cast("int").alias("ring_id")
    )


def ring_members(components: DataFrame, min_size: int = K.MIN_RING) -> DataFrame:
    """(ring_id, size, id): one row per member of a ring."""
    rings = with_ring_numbers(component_sizes(components), min_size)
    return components.join(rings, "component").select("ring_id", "size", "id")


def ring_table(members: DataFrame, risk: DataFrame, loss: int = K.MULE_LOSS) -> DataFrame:
    """Per ring: size, lead account (highest risk, lowest id on a tie), its score, exposure.

    `risk` holds id and risk_score. Members stay in the member table; a ring can be large.
    """
    scored = members.join(risk.groupBy("id").agg(F.max("risk_score").alias("risk_score")), "id", "left")
    lead = F.min_by(F.struct("id", "risk_score"), F.struct(-F.coalesce("risk_score", F.lit(-1)), F.col("id")))
    return (
        scored.groupBy("ring_id")
        .agg(F.count(F.lit(1)).alias("size"), lead.alias("lead"))
        .select(
            "ring_id",
            "size",
            F.col("lead.id").alias("lead_account"),
            F.col("lead.risk_score").alias("lead_score"),
            (F.col("size") * loss).alias("exposure"),
        )
    )


def attach_ring(accounts: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Ring mark of each account, a dash for accounts outside all rings."""
    ring = members.select(F.col("id").alias(key), F.concat(F.lit("#"), F.col("ring_id").cast("string")).alias("ring"))
    return accounts.join(ring, key, "left").withColumn("ring", F.coalesce("ring", F.lit(K.NO_REASON)))


def node_degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def graph_summary(
    edges: DataFrame, components: DataFrame, min_size: int = K.MIN_RING, edge_count: Column | None = None
) -> DataFrame:
    """One row: nodes, edges, components, largest one, rings and nodes in rings.

    A spanning forest can stand for the edges; `edge_count` then adds up the edges it stands for.
    """
    rings = F.col("size") >= min_size
    sizes = component_sizes(components).agg(
        F.sum("size").alias("n_nodes"),
        F.count(F.lit(1)).alias("n_components"),
        F.max("size").alias("largest"),
        F.count_if(rings).alias("n_rings"),
        F.coalesce(F.sum(F.when(rings, F.col("size"))), F.lit(0)).alias("nodes_in_rings"),
    )
    return sizes.withColumns(
        {
            "n_edges": edges.agg((F.count(F.lit(1)) if edge_count is None else edge_count).alias("c")).scalar(),
            "nodes_with_tie": node_degrees(edges.where("src <> dst")).agg(F.count(F.lit(1)).alias("c")).scalar(),
        }
    )


def component_purity(components: DataFrame, marked: DataFrame, min_size: int = K.MIN_RING) -> DataFrame:
    """Per component of enough size: members and the share that is marked. `marked` holds id."""
    flags = marked.select("id").distinct().withColumn("_m", F.lit(1))
    return (
        components.join(flags, "id", "left")
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("size"), F.avg(F.coalesce("_m", F.lit(0)).cast("double")).alias("purity"))
        .where(F.col("size") >= min_size)
    )


def planted_members(alerts: DataFrame) -> DataFrame:
    """(alert_id, id): senders and receivers of each planted ring, once each."""
    ends = F.explode(F.array("sender", "receiver")).alias("id")
    return alerts.select("alert_id", ends).distinct()


def ring_recovery(planted: DataFrame, components: DataFrame) -> DataFrame:
    """Best Jaccard overlap of each planted ring with any component, zero when none meets it."""
    planted_size = planted.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n_planted"))
    sizes = component_sizes(components)
    shared = (
        planted.join(components, "id")
        .groupBy("alert_id", "component")
        .agg(F.count(F.lit(1)).alias("n_shared"))
        .join(sizes, "component")
        .join(planted_size, "alert_id")
    )
    jaccard = F.col("n_shared") / (F.col("n_planted") + F.col("size") - F.col("n_shared"))
    best = shared.groupBy("alert_id").agg(F.max(jaccard).alias("best"))
    return planted_size.join(best, "alert_id", "left").select(
        "alert_id", "n_planted", F.coalesce("best", F.lit(0.0)).alias("best_jaccard")
    )


def recovery_summary(recovered: DataFrame) -> DataFrame:
    best = F.col("best_jaccard")
    return recovered.agg(
        F.count(F.lit(1)).alias("n_planted"),
        F.avg(best).alias("mean_best_jaccard"),
        F.count_if(best >= 0.5).alias("recovered_half"),
        F.count_if(best >= 0.8).alias("recovered_most"),
        F.avg((best >= 0.5).cast("double")).alias("recovery_rate"),
    )


def typology_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count_distinct("alert_id").alias("n_alerts"))


def typology_examples(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lowest alert of each type: a summary row per type, and its transfer edges."""
    first = alerts.groupBy("alert_type").agg(F.min("alert_id").alias("alert_id"))
    edges = alerts.join(first, ["alert_type", "alert_id"])
    ends = edges.select("alert_type", F.explode(F.array("sender", "receiver")).alias("id")).distinct()
    accounts = ends.groupBy("alert_type").agg(F.count(F.lit(1)).alias("n_accounts"))
    summary = (
        edges.groupBy("alert_type", "alert_id")
        .agg(F.count(F.lit(1)).alias("n_edges"), F.sum("amount").alias("total_amount"))
        .join(accounts, "alert_type")
    )
    return summary, edges


def typology_hub(edges: DataFrame) -> DataFrame:
    """Most connected account of each typology, lowest id on a tie."""
    ends = edges.select("alert_type", F.explode(F.array("sender", "receiver")).alias("id"))
    degree = ends.groupBy("alert_type", "id").agg(F.count(F.lit(1)).alias("degree"))
    return degree.groupBy("alert_type").agg(
        F.min_by("id", F.struct(-F.col("degree"), F.col("id"))).alias("hub"), F.max("degree").alias("hub_degree")
    )


def with_node_risk(edges: DataFrame, risk: DataFrame) -> DataFrame:
    """Edges pointed from the lower to the higher risk; unknown risk counts as zero.

    On equal risk the edge keeps its direction. `risk` holds id and risk_score.
    """
    known = risk.groupBy("id").agg(F.max("risk_score").alias("r"))
    out = (
        edges.join(known.select(F.col("id").alias("src"), F.col("r").alias("_a")), "src", "left")
        .join(known.select(F.col("id").alias("dst"), F.col("r").alias("_b")), "dst", "left")
        .withColumns({"_a": F.coalesce("_a", F.lit(0)), "_b": F.coalesce("_b", F.lit(0))})
    )
    up = F.col("_a") <= F.col("_b")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return out.select(
        F.when(up, F.col("src")).otherwise(F.col("dst")).alias("source"),
        F.when(up, F.col("dst")).otherwise(F.col("src")).alias("target"),
        F.least("_a", "_b").alias("source_risk"),
        F.greatest("_a", "_b").alias("target_risk"),
        *rest,
    )


def edges_inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members."""
    ids = members.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(
        ids.select(F.col("id").alias("dst")), "dst", "left_semi"
    )
