"""Named queries and their SQL twins."""


def _load():
    from riskloom.plans import code_queries, flow_queries, learned_queries, registry, risk_queries, scan_queries, tree_queries, vector_queries, whole_queries  # noqa: F401

    return registry


def queries() -> dict:
    return _load().QUERIES


def twins() -> dict:
    return _load().SQL
