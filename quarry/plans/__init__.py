from quarry.plans.catalog import QUERIES, ORACLES, register  # noqa: F401
