"""Names of the registered queries."""

from __future__ import annotations

from . import detection, facts, kept, links, scalars, scoring, streams, upkeep, whatif

MODULES = [scalars, detection, scoring, upkeep, facts, whatif, kept, links, streams]


def flagship(spark, sf_dir):
    return queries()["j15_blast_radius"](spark, sf_dir)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
