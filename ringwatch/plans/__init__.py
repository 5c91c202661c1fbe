"""Bindings of the sample tables and the named queries built on them."""


def load_queries():
    """All named queries and their reference SQL."""
    from ringwatch.plans import audit_queries, feed_queries, graph_queries, model_queries, score_queries  # noqa: F401
    from ringwatch.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
