"""Named queries over the test tables, one or more per operator."""

from importlib import import_module

MODULES = ["metric_queries", "transform_queries", "curve_queries", "patch_queries", "orient_queries", "run_queries"]


def load():
    """All registered queries and their SQL, as two dictionaries."""
    from pointlake.catalog import registry

    for name in MODULES:
        import_module(f"pointlake.catalog.{name}")
    return registry.QUERIES, registry.ORACLES
