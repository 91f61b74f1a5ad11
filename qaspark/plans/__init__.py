"""Named queries over the given tables, each with the SQL that states its result."""

from importlib import import_module

FAMILIES = (
    "template_queries", "dataset_queries", "curriculum_queries", "augment_queries", "region_queries",
    "evaluation_queries",
)


def load_catalog():
    """All queries and stated results, by name."""
    for family in FAMILIES:
        import_module(f"qaspark.plans.{family}")
    from qaspark.plans.catalog import QUERIES, STATED

    return QUERIES, STATED
