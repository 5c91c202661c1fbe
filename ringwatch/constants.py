"""Numbers, names and texts that results must carry as they are."""

# Accepted column names per feed role, lower case, first match wins.
TRANSACTION_ROLES = {
    "amount": ["amount", "amt", "txn_amount", "tx_amount", "transactionamount"],
    "txn_type": ["type", "txn_type", "tx_type", "transactiontype"],
    "old_orig": ["oldbalanceorg", "oldbalanceorig", "orig_old_balance"],
    "new_orig": ["newbalanceorig", "newbalanceorg", "orig_new_balance"],
    "old_dest": ["oldbalancedest", "dest_old_balance"],
    "new_dest": ["newbalancedest", "dest_new_balance"],
    "origin": ["nameorig", "sender", "sender_account_id", "orig", "from_account"],
    "dest": ["namedest", "receiver", "receiver_account_id", "dest", "to_account"],
    "channel": ["channel", "rail", "mode", "payment_channel", "txn_channel"],
}
RAIL_ROLES = {
    "account": ["nameorig", "sender", "account", "account_id", "orig", "from_account"],
    "channel": ["channel", "rail", "mode", "payment_channel", "txn_channel"],
    "amount": ["amount", "amt", "txn_amount"],
}
ALERT_ROLES = {
    "account": ["account", "account_id", "acct", "accountid", "nameorig", "customer_id"],
    "source": ["source", "feed", "system"],
    "severity": ["severity", "priority"],
}
REGULATOR_ROLES = {
    "account": ["account", "account_id", "beneficiary_account", "mule_account", "acct", "nameorig"],
    "severity": ["severity", "priority", "category"],
    "ticket": ["ticket", "ticket_id", "complaint_id", "ack_no"],
}

# Transaction rules (limits, points, reason texts).
HIGH_VALUE_QUANTILE = 0.99
STRUCTURING_LIMITS = [10000, 50000, 100000, 200000]
STRUCTURING_FLOOR = 0.9
CASH_OUT_TYPES = ["CASH_OUT", "TRANSFER", "WITHDRAWAL"]
VELOCITY_MIN = 5
RAILS_MIN = 2
FLAG_MIN = 50
MAX_SUSPICION = 100
RULE_POINTS = {
    "high_value": 30,
    "structuring": 25,
    "drained": 25,
    "origin_gap": 15,
    "dest_gap": 15,
    "cash_channel": 10,
    "chain": 20,
    "velocity": 10,
    "rails": 15,
}
RULE_REASONS = {
    "high_value": "high-value (top 1% by amount)",
    "structuring": "structuring (just under {limit:,})",
    "drained": "account drained to zero",
    "origin_gap": "origin balance inconsistency",
    "dest_gap": "destination balance inconsistency (pass-through)",
    "cash_channel": "cash-out/transfer channel",
    "chain": "layering chain (transfer-in then cash-out)",
    "velocity": "high velocity (>=5 txns by this account)",
    "rails": "cross-channel layering (>=2 payment rails)",
}
NO_REASON = "—"

# Containment steps, ticket fusion, bands, tiers.
CONTAINMENT = [(70, "FREEZE + ESCALATE"), (50, "HOLD + REVIEW")]
CONTAINMENT_DEFAULT = "monitor"
FUSION_STATUS = [(70, "CORROBORATED — escalate"), (40, "model also elevated")]
FUSION_DEFAULT = "model low / unknown — review"
DEFAULT_ALERT_SOURCE = "external"
DEFAULT_ALERT_SEVERITY = "—"
REGULATOR_SOURCE = "Govt-I4C"
REGULATOR_SEVERITY = "HIGH"
BANDS = [(90, "CRITICAL"), (70, "HIGH"), (40, "MEDIUM"), (0, "LOW")]
BAND_ORDER = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
BAND_ACTIONS = {
    "CRITICAL": "Freeze outbound transfers immediately; escalate to L2 fraud unit; file internal SAR review.",
    "HIGH": "Hold high-value outbound transactions; assign to analyst for same-day review.",
    "MEDIUM": "Add to enhanced-monitoring watchlist; review on next cycle.",
    "LOW": "No action; routine monitoring.",
}
TIERS = ("CONFIDENT-MULE", "CONFIDENT-LEGIT", "UNCERTAIN")
DEFAULT_T_LO = 0.10
DEFAULT_T_HI = 0.90

# Leak audit.
AUDIT_MIN_ROWS = 10
AUDIT_RATES = [("CRITICAL", 0.90), ("HIGH", 0.50), ("MEDIUM", 0.20), ("WATCH", 0.10)]
AUDIT_AUC_CRITICAL = 0.98
AUDIT_AUC_HIGH = 0.95
AUDIT_MIN_POSITIVES = 10
LEAK_RATE = 0.10
LEAK_SWEEP = [1.01, 0.30, 0.20, 0.10, 0.05, 0.03, 0.02]
INJECTED_FLIP_RATE = 0.03

# Snapshot hygiene.
SNAPSHOT_TARGET = "F3924"
SNAPSHOT_BLOCKED = ["F3912"]
SNAPSHOT_HINTED = [
    "F115", "F321", "F527", "F531", "F670", "F1692", "F2082", "F2122", "F2582", "F2678",
    "F2737", "F2956", "F3043", "F3836", "F3887", "F3889", "F3891", "F3894",
]
SNAPSHOT_TAIL = (3895, 3923)
MISSING_FLAG_MIN = 0.30
MISSING_DROP_MIN = 0.97
MIN_FILLED = 30
FLAG_SUFFIX = "__ismissing"
CONTINUOUS_MIN_DISTINCT = 20
RATIO_EPSILON = 1e-6

# Labels of the few self-describing snapshot columns.
TENURE_LABELS = {
    "L31D": "account tenure < 31 days (very new)",
    "L90D": "account tenure < 90 days (new)",
    "L180D": "account tenure < 180 days",
    "L365D": "account tenure < 1 year",
    "G365D": "account tenure > 1 year (established)",
}
COLUMN_LABELS = {
    "F3891": "customer occupation",
    "F3889": "account tenure bucket",
    "F3894": "customer age (inferred)",
    "F3836": "large-value monetary field (inferred)",
    "F670": "binary flag",
    "F2956": "0-100 bounded indicator (inferred)",
    "F1692": "low-count indicator 0-12 (inferred)",
    "F2082": "ratio 0-1 (inferred)",
    "F2122": "ratio 0-1 (inferred)",
}

# Money assumptions of the decision policies.
MULE_LOSS = 250000
REVIEW_COST = 400
WRONG_ALERT_HARM = 5000
STEP_UP_COST = 50
WRONG_FREEZE_HARM = 25000
FREEZE_MIN = 0.90
NAIVE_FREEZE_MIN = 0.5
TARGET_PRECISION = 0.95
TARGET_NPV = 0.999
SHIFT_MINUTES = 8 * 60

# Threshold grids, written out in hundredths or thousandths.
COST_GRID = [0.01, 0.02, 0.03] + [n / 100 for n in range(5, 100, 5)]
PERCENT_GRID = [n / 100 for n in range(1, 100)]
RECALL_GRID = [n / 1000 for n in range(5, 1000, 5)]
DIAL_GRID = [0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99]
RECALL_TARGET = 0.97
RECALL_LADDER = [0.90, 0.95, 0.97, 0.99]

# Graph, evaluation and case log.
EDGE_QUANTILE = 0.94
MIN_RING = 3
EGO_NEIGHBOURS = 12
SIMILAR_POSITIVES = 5
RANDOM_GROUPS = 300
T_CRITICAL_DF9 = 2.262157162740992
NORMAL_CRITICAL = 1.96
BOOTSTRAP_REPLICATES = 2000
EXPLICIT_ACTIONS = ["ESCALATED", "CLEARED", "MONITORED"]
CASE_STATUSES = ["NEW", "INVESTIGATING", "ESCALATED", "CLEARED"]

# Levels of the robustness tests.
NOISE_LEVELS = [0.0, 0.1, 0.25, 0.5, 1.0]
DROP_LEVELS = [0.0, 0.1, 0.25, 0.5]
