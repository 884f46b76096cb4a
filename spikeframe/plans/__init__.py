"""Registered queries: name -> callable(spark, folder), and name -> oracle SQL."""

from . import algebra, benchmark, layout, measurements, order, relational, simulation, sorting

QUERIES, ORACLES = {}, {}
for _module in (simulation, layout, sorting, algebra, benchmark, relational, measurements, order):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
