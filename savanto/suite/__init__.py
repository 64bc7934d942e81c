"""Every runnable query of the package, next to the plain SQL that gives the same rows."""

from savanto.suite.registry import CASES


def load() -> dict:
    """All cases by name."""
    from savanto.suite import graph, identity, ingest, qa, rank, scalars, streams, text  # noqa: F401

    return CASES
