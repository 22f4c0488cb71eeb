"""Queries that read a derived graph several times work it out once."""

from spandrel.plans import catalog


def test_edges_dedup_reads_the_tables_once(spark, data):
    """Before, the joins below the edges ran four times."""
    plan = catalog.QUERIES["edges_dedup"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan
