"""Registered queries of the lexicon engine."""


def load() -> tuple[dict, dict]:
    from lexloom.plans import answer_queries, build_queries, check_queries, full_queries, layout_queries, pack_queries, registry, release_queries, root_queries, rule_queries, sense_queries, use_queries  # noqa: F401

    return registry.QUERIES, registry.ORACLES
