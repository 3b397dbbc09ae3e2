"""Registered queries: library operators applied to the given tables."""


def _modules():
    from papergraph.plans import layout, papers, readers

    return layout, papers, readers


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
