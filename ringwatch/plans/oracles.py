"""Reference SQL of the registered queries, for the side-by-side check on the same tables."""

FEED = """
d AS (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
feed AS (
  SELECT o_orderkey AS txn_id, o_custkey AS origin, d.s AS dest, o_totalprice AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'TRANSFER' WHEN 'O' THEN 'CASH_OUT' ELSE 'PAYMENT' END AS txn_type,
         o_orderpriority AS channel,
         c_acctbal * 50 AS old_orig, greatest(c_acctbal * 50 - o_totalprice, 0) AS new_orig,
         s_acctbal AS old_dest,
         s_acctbal + CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END AS new_dest
  FROM orders JOIN customer ON c_custkey = o_custkey
  LEFT JOIN d ON d.l_orderkey = o_orderkey
  LEFT JOIN supplier ON s_suppkey = d.s
),
chain AS (
  SELECT dest AS a FROM feed WHERE txn_type = 'TRANSFER' AND dest IS NOT NULL
  INTERSECT
  SELECT origin FROM feed WHERE txn_type = 'CASH_OUT' AND origin IS NOT NULL
)
"""

SCORED = (
    FEED
    + """,
acct AS (SELECT origin AS a, count(amount) AS c, count(DISTINCT channel) AS r FROM feed GROUP BY 1),
hv AS (SELECT quantile_cont(amount, 0.99) AS t FROM feed WHERE amount > 0),
hits AS (
  SELECT f.*,
    amount >= (SELECT t FROM hv) AS h1,
    amount >= 9000 AND amount < 10000 AS h2, amount >= 45000 AND amount < 50000 AS h3,
    amount >= 90000 AND amount < 100000 AS h4, amount >= 180000 AND amount < 200000 AS h5,
    coalesce(new_orig, 0) = 0 AND coalesce(old_orig, 0) > 0 AS h6,
    abs(coalesce(new_orig, 0) + amount - coalesce(old_orig, 0)) > 1 AND coalesce(old_orig, 0) > 0 AS h7,
    abs(coalesce(old_dest, 0) + amount - coalesce(new_dest, 0)) > 1 AND amount > 0 AS h8,
    txn_type IN ('CASH_OUT', 'TRANSFER', 'WITHDRAWAL') AS h9,
    origin IN (SELECT a FROM chain) OR coalesce(dest IN (SELECT a FROM chain), false) AS h10,
    coalesce(acct.c >= 5, false) AS h11, coalesce(acct.r >= 2, false) AS h12
  FROM feed f LEFT JOIN acct ON acct.a = f.origin
),
pre AS (
  SELECT *, least(100,
      30 * h1::INT + 25 * (h2::INT + h3::INT + h4::INT + h5::INT) + 25 * h6::INT + 15 * h7::INT + 15 * h8::INT
      + 10 * h9::INT + 20 * h10::INT + 10 * h11::INT + 15 * h12::INT)::INT AS suspicion_score,
    coalesce(nullif(concat_ws('; ',
      CASE WHEN h1 THEN 'high-value (top 1% by amount)' END,
      CASE WHEN h2 THEN 'structuring (just under 10,000)' END,
      CASE WHEN h3 THEN 'structuring (just under 50,000)' END,
      CASE WHEN h4 THEN 'structuring (just under 100,000)' END,
      CASE WHEN h5 THEN 'structuring (just under 200,000)' END,
      CASE WHEN h6 THEN 'account drained to zero' END,
      CASE WHEN h7 THEN 'origin balance inconsistency' END,
      CASE WHEN h8 THEN 'destination balance inconsistency (pass-through)' END,
      CASE WHEN h9 THEN 'cash-out/transfer channel' END,
      CASE WHEN h10 THEN 'layering chain (transfer-in then cash-out)' END,
      CASE WHEN h11 THEN 'high velocity (>=5 txns by this account)' END,
      CASE WHEN h12 THEN 'cross-channel layering (>=2 payment rails)' END), ''), '—') AS reasons
  FROM hits
),
scored AS (SELECT *, suspicion_score >= 50 AS flag FROM pre),
rollup_rows AS (
  SELECT origin AS account, count(*) AS txns, max(suspicion_score) AS max_suspicion,
         count(*) FILTER (flag) AS suspicious_txns,
         round(sum(CASE WHEN flag THEN amount ELSE 0 END), 2) AS suspicious_value
  FROM scored WHERE origin IS NOT NULL GROUP BY 1
)
"""
)

RUNS = """
li AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS account_id,
         floor(l_extendedprice / 20.0::DOUBLE) / 10000.0::DOUBLE AS price,
         floor(l_quantity * 140 + l_discount * 30000 + 0.5::DOUBLE) / 10000.0::DOUBLE AS mixed,
         (l_returnflag = 'R')::INT AS common,
         (l_returnflag = 'R' AND l_quantity >= 45 AND l_discount >= 0.08::DOUBLE)::INT AS rare
  FROM lineitem
),
runs AS (
  SELECT 'price' AS run, account_id, price AS score, common AS label FROM li
  UNION ALL SELECT 'mixed', account_id, mixed, common FROM li
  UNION ALL SELECT 'rare', account_id, mixed, rare FROM li
)
"""

CURVE = (
    RUNS
    + """,
h AS (SELECT run, score, count(*) AS n, sum(label) AS pos FROM runs GROUP BY 1, 2),
curve AS (
  SELECT run, score, n, pos,
    sum(n) OVER (PARTITION BY run ORDER BY score DESC) AS alerts,
    sum(pos) OVER (PARTITION BY run ORDER BY score DESC) AS tp,
    sum(n) OVER (PARTITION BY run) AS n_rows, sum(pos) OVER (PARTITION BY run) AS n_pos
  FROM h
)
"""
)

RARE = RUNS + ", rare AS (SELECT account_id, score, label FROM runs WHERE run = 'rare')"


def _grid(name: str, values: list[float]) -> str:
    rows = ", ".join(f"({v}::DOUBLE)" for v in values)
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS g(threshold))"


def threshold_sql(grid: list[float]) -> str:
    return (
        RUNS
        + ","
        + _grid("grid", grid)
        + """,
tt AS (
  SELECT run, threshold, count(*) FILTER (score >= threshold) AS alerts,
    coalesce(sum(label) FILTER (score >= threshold), 0)::BIGINT AS caught,
    sum(label)::BIGINT AS n_pos, count(*) AS n_rows
  FROM runs CROSS JOIN grid
  GROUP BY 1, 2
),
tbl AS (
  SELECT run, threshold, alerts, caught, alerts - caught AS false_alarms,
    CASE WHEN alerts > 0 THEN caught::DOUBLE / alerts ELSE 0 END AS precision,
    caught::DOUBLE / n_pos AS recall, n_pos, n_rows
  FROM tt
)
"""
    )


AUDIT = """
li AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS account_id,
         (l_returnflag = 'R' AND l_quantity >= 45 AND l_discount >= 0.08::DOUBLE)::INT AS label,
         l_quantity, l_tax, l_discount, l_extendedprice, l_suppkey::DOUBLE AS l_suppkey
  FROM lineitem
),
lp AS (
  SELECT *, CASE WHEN concat('0x', substr(md5('42:' || account_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.03::DOUBLE
                 THEN 1.0::DOUBLE - label ELSE label::DOUBLE END AS planted
  FROM li
),
long AS (
  SELECT account_id, 'l_quantity' AS feature, l_quantity AS value, label FROM lp
  UNION ALL SELECT account_id, 'l_tax', l_tax, label FROM lp
  UNION ALL SELECT account_id, 'l_discount', l_discount, label FROM lp
  UNION ALL SELECT account_id, 'l_extendedprice', l_extendedprice, label FROM lp
  UNION ALL SELECT account_id, 'l_suppkey', l_suppkey, label FROM lp
  UNION ALL SELECT account_id, 'planted', planted, label FROM lp
)
"""


def purity_sql(source: str, by: str) -> str:
    """Signature CTEs over a long table (feature, value, label), grouped by extra columns."""
    keys = f"{by}, feature" if by else "feature"
    return f"""
tot AS (
  SELECT {keys}, count(*) AS n_rows, sum(label)::BIGINT AS n_pos, count(DISTINCT value) AS n_distinct
  FROM {source} WHERE value IS NOT NULL GROUP BY ALL
),
bk AS (
  SELECT {keys}, max(rate) FILTER (rows >= 10) AS bucket_rate FROM (
    SELECT {keys}, round_even(value, 3) AS b, count(*) AS rows, avg(label::DOUBLE) AS rate
    FROM {source} WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL
),
srt AS (SELECT {keys}, list(value ORDER BY value) AS s, count(*) - 1 AS m FROM {source} WHERE value IS NOT NULL GROUP BY ALL),
eg AS (
  SELECT {keys}, list_sort(list_distinct(list_transform(range(0, 11), lambda k:
    s[(k * m) // 10 + 1] + (s[least((k * m) // 10 + 2, m + 1)] - s[(k * m) // 10 + 1]) * (((k * m) % 10) / 10.0::DOUBLE)))) AS e
  FROM srt
),
dc AS (
  SELECT {keys}, max(rate) FILTER (rows >= 10) AS rate FROM (
    SELECT {keys}, greatest(1, len(list_filter(e, lambda x: x < value))) AS bin, count(*) AS rows, avg(label::DOUBLE) AS rate
    FROM {source} JOIN eg USING ({keys}) WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL
),
hh AS (SELECT {keys}, value, count(*) AS n, sum(label) AS pos FROM {source} WHERE value IS NOT NULL GROUP BY ALL),
rr AS (
  SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY {keys} ORDER BY value
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM hh
),
au AS (
  SELECT {keys}, greatest(a, 1 - a) AS auc FROM (
    SELECT {keys}, sum(pos::DOUBLE * (neg_below + (n - pos) / 2.0::DOUBLE))
      / nullif(sum(pos)::DOUBLE * sum(n - pos)::DOUBLE, 0) AS a FROM rr GROUP BY ALL)
),
sig AS (
  SELECT {keys}, n_rows, n_pos, n_distinct, coalesce(bucket_rate, 0) AS bucket_rate,
    CASE WHEN n_distinct >= 10 THEN coalesce(rate, 0) ELSE 0 END AS decile_rate, auc
  FROM tot JOIN bk USING ({keys}) JOIN dc USING ({keys}) LEFT JOIN au USING ({keys})
)
"""


SEVERITY = """
base AS (SELECT avg(label::DOUBLE) AS b FROM li),
sv AS (
  SELECT *, greatest(bucket_rate, decile_rate) AS worst,
    CASE WHEN n_pos >= 10 THEN auc ELSE 0 END AS ae
  FROM sig WHERE n_rows >= 10 AND n_pos > 0 AND n_pos < n_rows
),
found AS (
  SELECT *, CASE WHEN worst >= 0.9 OR ae >= 0.98 THEN 'CRITICAL' WHEN worst >= 0.5 OR ae >= 0.95 THEN 'HIGH'
    WHEN worst >= 0.2 THEN 'MEDIUM' WHEN worst >= 0.1 OR auc >= 0.95 THEN 'WATCH' END AS severity
  FROM sv
),
findings AS (
  SELECT feature, severity, n_pos AS positives_covered, round_even(auc, 3) AS univariate_auc,
    round_even(bucket_rate, 3) AS best_bucket_rate, round_even(decile_rate, 3) AS best_decile_rate,
    round_even(worst / (SELECT b FROM base), 1) AS lift_vs_base, feature = 'l_suppkey' AS hinted
  FROM found WHERE severity IS NOT NULL
)
"""

SNAPSHOT = """
per AS (
  SELECT o_custkey, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS value_f,
    sum(o_totalprice) FILTER (o_orderstatus = 'O') AS value_o, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS value_p,
    sum(1) FILTER (o_orderpriority = '1-URGENT') AS urgent_txns,
    max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent_max,
    sum(1) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS urgent_open,
    max(o_totalprice) FILTER (o_totalprice > 499500) AS huge_txn
  FROM orders GROUP BY 1
),
snap AS (
  SELECT c_custkey AS account_id, (c_acctbal < 0)::INT AS label, c_acctbal AS balance, c_nationkey AS nation,
    c_mktsegment AS segment, value_f, value_o, value_p, urgent_txns, urgent_max, urgent_open, huge_txn, 7 AS constant
  FROM customer LEFT JOIN per ON o_custkey = c_custkey
),
slong AS (
  SELECT account_id, label, unnest(['balance', 'nation', 'value_f', 'value_o', 'value_p', 'urgent_txns', 'urgent_max',
      'urgent_open', 'huge_txn', 'constant']) AS feature,
    unnest([balance, nation::DOUBLE, value_f, value_o, value_p, urgent_txns::DOUBLE, urgent_max, urgent_open::DOUBLE,
      huge_txn, constant::DOUBLE]) AS value
  FROM snap
)
"""

PROFILE = """
prof AS (
  SELECT feature, count(*) AS n_rows, count(value) AS n_filled, count(DISTINCT value) AS n_distinct
  FROM (SELECT feature, value::VARCHAR AS value FROM slong
        UNION ALL SELECT 'segment', segment FROM snap) GROUP BY 1
)
"""

VECTORS = """
cells AS (
  SELECT vec_id AS id, label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings
),
st AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM cells GROUP BY 1),
z AS (SELECT id, label, dim, CASE WHEN s > 0 THEN (x - m) / s ELSE x - m END AS x FROM cells JOIN st USING (dim)),
len AS (SELECT id, sqrt(sum(x * x)) AS l FROM z GROUP BY 1),
u AS (SELECT id, any_value(label) AS label, list(x / l ORDER BY dim) AS v FROM z JOIN len USING (id) GROUP BY 1),
pairs AS (
  SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.v, b.v), 6) AS similarity
  FROM u a JOIN u b ON a.id < b.id
)
"""

FLOWS = """
flows AS (
  SELECT l_suppkey + 1000000 AS sender, o_custkey AS receiver, l_extendedprice AS amount,
    l_returnflag = 'R' AND l_discount >= 0.10::DOUBLE AND l_quantity >= 45 AS bad,
    l_returnflag, l_discount, l_quantity
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
),
alerts AS (
  SELECT sender - 1000000 AS alert_id,
    CASE WHEN n_regionkey < 2 THEN 'fan_in' WHEN n_regionkey < 4 THEN 'fan_out' ELSE 'cycle' END AS alert_type,
    sender, receiver, amount
  FROM flows JOIN supplier ON s_suppkey + 1000000 = sender JOIN nation ON n_nationkey = s_nationkey
  WHERE l_returnflag = 'R' AND l_discount >= 0.09::DOUBLE AND l_quantity >= 46
),
edges AS (SELECT DISTINCT least(sender, receiver) AS src, greatest(sender, receiver) AS dst FROM flows WHERE bad)
"""

# Smallest reachable id per node: repeated relaxation along both edge directions.
COMPONENTS = """
link AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (
  SELECT a AS id, a AS r FROM link
  UNION
  SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.id WHERE reach.r < link.b
),
comp AS (SELECT id, min(r) AS component FROM reach GROUP BY 1)
"""

CASES = """
log AS (
  SELECT conv_id AS account, turn AS seq,
    CASE role WHEN 'user' THEN 'ESCALATED' WHEN 'assistant' THEN 'CLEARED' ELSE 'reviewed' END AS action,
    CASE role WHEN 'user' THEN 'INVESTIGATING' WHEN 'assistant' THEN 'ESCALATED' ELSE 'NEW' END AS status,
    CASE WHEN length(text) % 2 = 0 THEN 'priya' ELSE '' END AS owner,
    CASE WHEN length(text) > 120 THEN 'ALERT' ELSE 'clear' END AS decision,
    CASE WHEN length(text) > 200 THEN 'MULE' ELSE 'legit' END AS ground_truth
  FROM conversations
),
latest AS (
  SELECT account, arg_max(action, seq) AS action, max(seq) AS seq FROM log
  WHERE action IN ('ESCALATED', 'CLEARED', 'MONITORED') GROUP BY 1
)
"""

EVENTS = """
ev AS (
  SELECT event_id, ts, user_id AS account, value * 400 AS amount,
    CASE event_type WHEN 'signup' THEN 'TRANSFER' WHEN 'purchase' THEN 'CASH_OUT' ELSE 'PAYMENT' END AS kind,
    event_type AS channel FROM events
)
"""

HASH = "concat('0x', substr(md5({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
