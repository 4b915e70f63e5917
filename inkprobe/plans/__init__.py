"""Plans that combine operators, and the registered queries."""


def all_queries():
    """(queries, SQL twins) by name."""
    from inkprobe.plans import (  # noqa: F401
        corpus_queries,
        ngram_queries,
        registry,
        score_queries,
        token_queries,
    )

    return dict(registry.QUERIES), dict(registry.TWINS)
