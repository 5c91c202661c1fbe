"""Queries on similarity graphs, money flows, rings and the case log."""

from pyspark.sql import functions as F

from ringwatch.operators import cases, similarity
from ringwatch.operators import components as C
from ringwatch.plans import bindings as B
from ringwatch.plans import oracles as O
from ringwatch.plans.registry import query, rounded

RING_QUANTILE = 0.995


@query("sim_cut", f"WITH {O.VECTORS} SELECT round(quantile_cont(similarity, 0.94), 6) AS cut, count(*) AS n_pairs FROM pairs")
def sim_cut(spark, sf):
    units = similarity.standard_units(B.vectors(spark, sf))
    row = [(similarity.similarity_cut(units), similarity.pair_count(units))]
    return rounded(spark.createDataFrame(row, "cut double, n_pairs long"), 6, "cut")


@query("sim_edges", f"WITH {O.VECTORS} SELECT src, dst, similarity FROM pairs WHERE similarity >= (SELECT quantile_cont(similarity, 0.94) FROM pairs)")
def sim_edges(spark, sf):
    return similarity.similarity_graph(B.vectors(spark, sf))


_SIM_RINGS = f"""{O.VECTORS},
edges AS (SELECT src, dst FROM pairs WHERE similarity >= (SELECT quantile_cont(similarity, 0.995) FROM pairs)),
{O.COMPONENTS},
sz AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) >= 3),
rg AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS ring_id FROM sz)"""


def _sim_components(spark, sf):
    return C.connected_components(similarity.similarity_graph(B.vectors(spark, sf), RING_QUANTILE, forest=True))


@query("sim_components", f"WITH RECURSIVE {_SIM_RINGS} SELECT id, component FROM comp")
def sim_components(spark, sf):
    return _sim_components(spark, sf)


@query("sim_rings", f"""WITH RECURSIVE {_SIM_RINGS},
m AS (SELECT ring_id::INT AS ring_id, size, id, (id * 37) % 101 AS r FROM rg JOIN comp USING (component))
SELECT ring_id, size, arg_max(id, r * 1000000000 - id) AS lead_account, max(r)::INT AS lead_score, size * 250000 AS exposure FROM m GROUP BY 1, 2""")
def sim_rings(spark, sf):
    members = C.ring_members(_sim_components(spark, sf))
    risk = B.vectors(spark, sf).select("id", F.pmod(F.col("id") * 37, F.lit(101)).cast("int").alias("risk_score"))
    return C.ring_table(members, risk)


@query("ring_members", f"WITH RECURSIVE {_SIM_RINGS} SELECT ring_id::INT AS ring_id, size, id FROM rg JOIN comp USING (component)")
def ring_members(spark, sf):
    return C.ring_members(_sim_components(spark, sf))


@query("graph_summary", f"""WITH RECURSIVE {_SIM_RINGS}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY 1)
SELECT sum(size)::BIGINT AS n_nodes, count(*) AS n_components, max(size) AS largest, count(*) FILTER (size >= 3) AS n_rings,
  coalesce(sum(size) FILTER (size >= 3), 0)::BIGINT AS nodes_in_rings, (SELECT count(*) FROM edges) AS n_edges,
  (SELECT count(DISTINCT a) FROM link) AS nodes_with_tie FROM s""")
def graph_summary(spark, sf):
    links = similarity.similarity_graph(B.vectors(spark, sf), RING_QUANTILE, forest=True)
    return C.graph_summary(links, C.connected_components(links), edge_count=F.coalesce(F.sum("pairs"), F.lit(0)))


@query("watchlist_rings", f"""WITH RECURSIVE {_SIM_RINGS}, t AS (SELECT vec_id AS account_id, (vec_id * 37) % 101 AS risk_score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 50)
SELECT account_id, risk_score::INT AS risk_score, coalesce('#' || ring_id, '—') AS ring FROM t LEFT JOIN (SELECT id, ring_id FROM rg JOIN comp USING (component)) m ON m.id = account_id""")
def watchlist_rings(spark, sf):
    from ringwatch.operators.metrics import watchlist

    accounts = B.vectors(spark, sf).select(
        F.col("id").alias("account_id"), F.pmod(F.col("id") * 37, F.lit(101)).cast("int").alias("risk_score")
    )
    return C.attach_ring(watchlist(accounts, 50), C.ring_members(_sim_components(spark, sf)), "account_id")


@query("ego_network", f"""WITH {O.VECTORS}
SELECT b.id, round_even(list_dot_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.id <> b.id WHERE a.id = 7 ORDER BY 2 DESC, 1 LIMIT 12""")
def ego_network(spark, sf):
    return similarity.ego_network(B.vectors(spark, sf), 7)


@query("positive_similarity", """WITH c AS (SELECT vec_id AS id, label, (vec_id % 5)::INT AS fold, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
l AS (SELECT id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1),
u AS (SELECT id, any_value(label) AS label, any_value(fold) AS fold, list(x / n ORDER BY dim) AS v FROM c JOIN l USING (id) GROUP BY 1),
s AS (SELECT a.id, list_dot_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC) AS k
      FROM u a JOIN u b ON b.label = 0 AND a.fold <> b.fold)
SELECT id, round(avg(s), 6) AS positive_similarity FROM s WHERE k <= 5 GROUP BY 1""")
def positive_similarity(spark, sf):
    rows = B.vectors(spark, sf).select(
        "id", "vector", (F.col("label") == 0).cast("int").alias("is_positive"), F.pmod("id", F.lit(5)).alias("fold")
    )
    return rounded(similarity.similarity_to_positives(rows, "is_positive", "fold"), 6, "positive_similarity")


@query("fold_positive_similarity", """WITH c AS (SELECT vec_id AS id, label, (vec_id % 5)::INT AS own, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
g AS (SELECT id, label, own, dim, CASE WHEN (id * 7 + dim) % 29 = 0 THEN NULL ELSE x END AS x FROM c), f AS (SELECT unnest(range(0, 5))::INT AS fold),
md AS (SELECT fold, dim, quantile_cont(x, 0.5) AS med FROM g JOIN f ON own <> fold GROUP BY 1, 2),
fl AS (SELECT fold, id, label, own, dim, coalesce(x, med) AS x FROM g CROSS JOIN f JOIN md USING (fold, dim)),
st AS (SELECT fold, dim, avg(x) AS m, stddev_pop(x) AS s FROM fl WHERE own <> fold GROUP BY 1, 2),
z AS (SELECT fold, id, label, own, dim, CASE WHEN s > 0 THEN (x - m) / s ELSE x - m END AS x FROM fl JOIN st USING (fold, dim)),
l AS (SELECT fold, id, sqrt(sum(x * x)) AS n FROM z GROUP BY 1, 2),
u AS (SELECT fold, id, any_value(label) AS label, any_value(own) AS own, list(x / n ORDER BY dim) AS v FROM z JOIN l USING (fold, id) GROUP BY 1, 2),
s AS (SELECT a.fold, a.id, a.own = a.fold AS held_out, list_dot_product(a.v, b.v) AS s,
  row_number() OVER (PARTITION BY a.fold, a.id ORDER BY list_dot_product(a.v, b.v) DESC) AS k
  FROM u a JOIN u b ON a.fold = b.fold AND b.label = 0 AND b.own <> b.fold)
SELECT fold, id, held_out, round(avg(s), 6) AS positive_similarity FROM s WHERE k <= 5 GROUP BY 1, 2, 3""")
def fold_positive_similarity(spark, sf):
    gap = lambda x, i: F.when((F.col("id") * 7 + i + 1) % 29 != 0, x)
    rows = B.vectors(spark, sf).select(
        "id", F.transform("vector", gap).alias("vector"), (F.col("label") == 0).cast("int").alias("is_positive"), F.pmod("id", F.lit(5)).alias("fold")
    )
    return rounded(similarity.fold_similarity_to_positives(rows, "is_positive", "fold", 5), 6, "positive_similarity")


@query("ring_cohesion", f"""WITH RECURSIVE {_SIM_RINGS}, m AS (SELECT ring_id, id FROM rg JOIN comp USING (component))
SELECT a.ring_id::INT AS ring_id, max(size) AS n, round(avg(list_dot_product(x.v, y.v)), 6) AS cohesion
FROM m a JOIN m b ON a.ring_id = b.ring_id AND a.id < b.id JOIN u x ON x.id = a.id JOIN u y ON y.id = b.id JOIN rg ON rg.ring_id = a.ring_id GROUP BY 1""")
def ring_cohesion(spark, sf):
    vectors = B.vectors(spark, sf)
    return rounded(similarity.ring_cohesion(vectors, C.ring_members(_sim_components(spark, sf))), 6, "cohesion")


@query("random_groups", """WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS rn, count(*) OVER () AS t FROM embeddings WHERE label <> 0),
g AS (SELECT g, j, any_value(t) AS t FROM (SELECT DISTINCT t FROM n), (SELECT unnest(range(0, 300)) AS g), (SELECT unnest(range(0, 12)) AS j) GROUP BY 1, 2),
b AS (SELECT g, j, floor(j * t / 12.0::DOUBLE) AS f, floor((j + 1) * t / 12.0::DOUBLE) AS l FROM g),
p AS (SELECT g, f + floor(""" + O.HASH.format("'42g:' || g || ':' || j") + """ * (l - f)) AS rn FROM b WHERE l > f)
SELECT g::INT AS grp, vec_id AS id FROM p JOIN n USING (rn)""")
def random_groups(spark, sf):
    return similarity.random_groups(B.vectors(spark, sf).where("label <> 0").select("id"), 12)


@query("cohesion_against_chance")
def cohesion_against_chance(spark, sf):
    vectors = B.vectors(spark, sf)
    members = C.ring_members(_sim_components(spark, sf))
    size = members.where("ring_id = 1").count()
    return similarity.cohesion_against_chance(vectors, members, vectors.where("label <> 0").select("id"), size)


@query("ring_stability", f"""WITH RECURSIVE {O.VECTORS},
parts AS (SELECT r, d FROM (SELECT r, d, row_number() OVER (PARTITION BY r ORDER BY md5('42:' || (r - 1) || ':' || d)) AS k
  FROM (SELECT unnest(range(0, 31)) AS r), (SELECT unnest(range(0, 64)) AS d)) WHERE r = 0 OR k <= 51),
mz AS (SELECT r, id, dim, x FROM z JOIN parts ON d = dim - 1), ml AS (SELECT r, id, sqrt(sum(x * x)) AS l FROM mz GROUP BY 1, 2),
mu AS (SELECT r, id, list(x / l ORDER BY dim) AS v FROM mz JOIN ml USING (r, id) GROUP BY 1, 2),
mp AS (SELECT a.r, a.id AS src, b.id AS dst, round(list_dot_product(a.v, b.v), 6) AS s FROM mu a JOIN mu b ON a.r = b.r AND a.id < b.id),
mc AS (SELECT r, quantile_cont(s, {RING_QUANTILE}) AS c FROM mp GROUP BY 1),
edges AS (SELECT src * 31 + r AS src, dst * 31 + r AS dst FROM mp JOIN mc USING (r) WHERE s >= c),
{O.COMPONENTS},
sz AS (SELECT component % 31 AS r, component, count(*) AS n FROM comp GROUP BY 1, 2),
big AS (SELECT r, arg_max(component, n * 1000000000000 - component) AS component FROM sz GROUP BY 1),
mem AS (SELECT r, id // 31 AS id FROM comp JOIN big USING (component)),
base AS (SELECT id FROM mem WHERE r = 0)
SELECT r::INT AS replicate, count(b.id)::DOUBLE / (count(*) + (SELECT count(*) FROM base) - count(b.id)) AS jaccard
FROM mem LEFT JOIN base b USING (id) WHERE r > 0 GROUP BY 1""")
def ring_stability(spark, sf):
    return similarity.ring_stability(B.vectors(spark, sf), 64, RING_QUANTILE)


def _edges(spark, sf):
    return C.flow_graph(B.money_flows(spark, sf), C.is_true("is_fraud"))


@query("flow_edges", f"WITH {O.FLOWS} SELECT src, dst FROM edges")
def flow_edges(spark, sf):
    return _edges(spark, sf)


@query("flow_components", f"WITH RECURSIVE {O.FLOWS}, {O.COMPONENTS} SELECT id, component FROM comp")
def flow_components(spark, sf):
    return C.connected_components(_edges(spark, sf))


@query("flow_largest", f"WITH RECURSIVE {O.FLOWS}, {O.COMPONENTS} SELECT component, count(*) AS size FROM comp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def flow_largest(spark, sf):
    sizes = C.component_sizes(C.connected_components(_edges(spark, sf)))
    return sizes.orderBy(F.desc("size"), "component").limit(8)


@query("node_degrees", f"WITH {O.FLOWS} SELECT id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS id FROM edges) GROUP BY 1")
def node_degrees(spark, sf):
    return C.node_degrees(_edges(spark, sf))


@query("component_purity", f"""WITH RECURSIVE {O.FLOWS}, {O.COMPONENTS}, bad AS (SELECT s_suppkey + 1000000 AS id FROM supplier WHERE s_acctbal < 3000)
SELECT component, count(*) AS size, avg((id IN (SELECT id FROM bad))::INT::DOUBLE) AS purity FROM comp GROUP BY 1 HAVING count(*) >= 3""")
def component_purity(spark, sf):
    marked = B.table(spark, sf, "supplier").where("s_acctbal < 3000").select((F.col("s_suppkey") + 1000000).alias("id"))
    return C.component_purity(C.connected_components(_edges(spark, sf)), marked)


_RECOVERY = f"""{O.FLOWS}, {O.COMPONENTS},
pm AS (SELECT DISTINCT alert_id, unnest([sender, receiver]) AS id FROM alerts),
ps AS (SELECT alert_id, count(*) AS n_planted FROM pm GROUP BY 1),
sz AS (SELECT component, count(*) AS size FROM comp GROUP BY 1),
sh AS (SELECT alert_id, component, count(*) AS k FROM pm JOIN comp USING (id) GROUP BY 1, 2),
j AS (SELECT alert_id, max(k::DOUBLE / (n_planted + size - k)) AS b FROM sh JOIN ps USING (alert_id) JOIN sz USING (component) GROUP BY 1),
rec AS (SELECT ps.alert_id, n_planted, coalesce(b, 0) AS best_jaccard FROM ps LEFT JOIN j USING (alert_id))"""


def _recovered(spark, sf):
    planted = C.planted_members(B.planted_alerts(spark, sf))
    return C.ring_recovery(planted, C.connected_components(_edges(spark, sf)))


@query("ring_recovery", f"WITH RECURSIVE {_RECOVERY} SELECT alert_id, n_planted, best_jaccard FROM rec")
def ring_recovery(spark, sf):
    return _recovered(spark, sf)


@query("recovery_summary", f"""WITH RECURSIVE {_RECOVERY} SELECT count(*) AS n_planted, round(avg(best_jaccard), 8) AS mean_best_jaccard,
  count(*) FILTER (best_jaccard >= 0.5) AS recovered_half, count(*) FILTER (best_jaccard >= 0.8) AS recovered_most,
  round(avg((best_jaccard >= 0.5)::INT::DOUBLE), 8) AS recovery_rate FROM rec""")
def recovery_summary(spark, sf):
    return rounded(C.recovery_summary(_recovered(spark, sf)), 8, "mean_best_jaccard", "recovery_rate")


@query("planted_members", f"WITH {O.FLOWS} SELECT DISTINCT alert_id, unnest([sender, receiver]) AS id FROM alerts")
def planted_members(spark, sf):
    return C.planted_members(B.planted_alerts(spark, sf))


@query("typology_counts", f"WITH {O.FLOWS} SELECT alert_type, count(DISTINCT alert_id) AS n_alerts FROM alerts GROUP BY 1")
def typology_counts(spark, sf):
    return C.typology_counts(B.planted_alerts(spark, sf))


@query("typology_examples", f"""WITH {O.FLOWS}, f AS (SELECT alert_type, min(alert_id) AS alert_id FROM alerts GROUP BY 1),
e AS (SELECT * FROM alerts JOIN f USING (alert_type, alert_id)),
n AS (SELECT alert_type, count(DISTINCT id) AS n_accounts FROM (SELECT alert_type, unnest([sender, receiver]) AS id FROM e) GROUP BY 1)
SELECT alert_type, alert_id, count(*) AS n_edges, round(sum(amount), 2) AS total_amount, max(n_accounts) AS n_accounts FROM e JOIN n USING (alert_type) GROUP BY 1, 2""")
def typology_examples(spark, sf):
    summary, _ = C.typology_examples(B.planted_alerts(spark, sf))
    return rounded(summary, 2, "total_amount")


@query("typology_hubs", f"""WITH {O.FLOWS}, f AS (SELECT alert_type, min(alert_id) AS alert_id FROM alerts GROUP BY 1),
d AS (SELECT alert_type, id, count(*) AS degree FROM (SELECT alert_type, unnest([sender, receiver]) AS id FROM alerts JOIN f USING (alert_type, alert_id)) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY alert_type ORDER BY degree DESC, id) AS k FROM d)
SELECT alert_type, id AS hub, degree AS hub_degree FROM r WHERE k = 1""")
def typology_hubs(spark, sf):
    _, edges = C.typology_examples(B.planted_alerts(spark, sf))
    return C.typology_hub(edges)


_RISK = "risk AS (SELECT c_custkey AS id, round_even(100 * ((c_acctbal + 1000) / 11000), 0)::INT AS r FROM customer WHERE c_custkey % 7 <> 0)"


def _node_risk(spark, sf):
    return B.account_risk(spark, sf).withColumnRenamed("account_id", "id")


@query("risk_edges", f"""WITH {O.FLOWS}, {_RISK},
e AS (SELECT src, dst, coalesce(a.r, 0) AS x, coalesce(b.r, 0) AS y FROM edges LEFT JOIN risk a ON a.id = src LEFT JOIN risk b ON b.id = dst)
SELECT CASE WHEN x <= y THEN src ELSE dst END AS source, CASE WHEN x <= y THEN dst ELSE src END AS target, least(x, y) AS source_risk, greatest(x, y) AS target_risk FROM e""")
def risk_edges(spark, sf):
    return C.with_node_risk(_edges(spark, sf), _node_risk(spark, sf))


@query("ring_edges", f"""WITH RECURSIVE {O.FLOWS}, {O.COMPONENTS}, big AS (SELECT id FROM comp JOIN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 3) USING (component))
SELECT src, dst FROM edges WHERE src IN (SELECT id FROM big) AND dst IN (SELECT id FROM big)""")
def ring_edges(spark, sf):
    edges = _edges(spark, sf)
    return C.edges_inside(edges, C.ring_members(C.connected_components(edges)))


@query("case_latest", f"WITH {O.CASES} SELECT account, action, seq FROM latest")
def case_latest(spark, sf):
    return cases.latest_actions(B.case_log(spark, sf))


@query("case_changes", f"""WITH {O.CASES}, r AS (SELECT *, lag(status) OVER w AS ps, lag(owner) OVER w AS po FROM log WHERE status <> 'NEW' OR owner <> '' WINDOW w AS (PARTITION BY account ORDER BY seq))
SELECT account, seq, CASE WHEN owner <> '' THEN status || ' · owner ' || owner ELSE status END AS change FROM r WHERE ps IS NULL OR ps <> status OR po <> owner""")
def case_changes(spark, sf):
    changed = cases.state_changes(B.case_log(spark, sf))
    return changed.select("account", "seq", cases.change_text(F.col("status"), F.col("owner")).alias("change"))


@query("case_summary", f"""WITH {O.CASES} SELECT count(*) AS reviews, count(DISTINCT account) AS distinct_accounts, count(*) FILTER (decision = 'ALERT') AS alerts_raised,
  count(*) FILTER (decision = 'ALERT' AND ground_truth = 'MULE') AS mules_caught FROM log""")
def case_summary(spark, sf):
    return cases.log_summary(B.case_log(spark, sf))


@query("case_actions", f"WITH {O.CASES} SELECT action, count(*) AS n_accounts FROM latest GROUP BY 1")
def case_actions(spark, sf):
    return cases.action_counts(B.case_log(spark, sf))


@query("case_status", f"""WITH {O.CASES}, a AS (SELECT doc_id AS account FROM labels WHERE quality = 1),
s AS (SELECT a.account, coalesce(status, 'NEW') AS status, coalesce(owner, '') AS owner FROM a LEFT JOIN (SELECT account, arg_max(status, seq) AS status, arg_max(owner, seq) AS owner FROM log GROUP BY 1) l USING (account))
SELECT count(*) AS open_alerts, count(*) FILTER (status = 'NEW') AS new, count(*) FILTER (status = 'INVESTIGATING') AS investigating,
  count(*) FILTER (status = 'ESCALATED') AS escalated, count(*) FILTER (status = 'CLEARED') AS cleared, count(*) FILTER (status <> 'NEW') AS handled, count(*) FILTER (owner <> '') AS assigned FROM s""")
def case_status(spark, sf):
    alerts = B.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("account"))
    return cases.status_counts(alerts, B.case_log(spark, sf))


_CONTAIN = f"""{_SIM_RINGS}, {O.CASES}, m AS (SELECT ring_id::INT AS ring_id, id FROM rg JOIN comp USING (component))"""


@query("ring_containment", f"""WITH RECURSIVE {_CONTAIN},
c AS (SELECT ring_id, count(*) AS size, count(*) FILTER (id IN (SELECT account FROM log)) AS reviewed,
  count(*) FILTER (id IN (SELECT account FROM latest WHERE action = 'ESCALATED')) AS escalated FROM m GROUP BY 1)
SELECT *, CASE WHEN escalated = size THEN 'Contained' WHEN reviewed > 0 THEN 'In progress' ELSE 'Open' END AS state, size * 250000 AS exposure,
  round(size * 250000 * (escalated::DOUBLE / size), 2) AS exposure_addressed FROM c""")
def ring_containment(spark, sf):
    members = C.ring_members(_sim_components(spark, sf))
    return rounded(cases.ring_containment(members, B.case_log(spark, sf)), 2, "exposure_addressed")


@query("ring_escalation", f"""WITH RECURSIVE {_CONTAIN} SELECT id AS account, '#1' AS ring, 'ESCALATED' AS action FROM m
WHERE ring_id = 1 AND id NOT IN (SELECT account FROM latest WHERE action = 'ESCALATED')""")
def ring_escalation(spark, sf):
    return cases.escalation_rows(C.ring_members(_sim_components(spark, sf)), B.case_log(spark, sf), 1)
