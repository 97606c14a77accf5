"""The query of remedies tried one by one, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models, whatif
from .fixture import AGE, GENDER, LABEL, PII, SECRET, oracle
from .scoring import Scored, audit_of
from .upkeep import EVERY

QUERIES, SQL = {}, {}
ROOTS = {"target_leakage": "label", "sensitive_source": "class"}


def next_sql(marks: str, *markers: str) -> str:
    """Columns that still have a mark of the set once their first one is taken away."""
    listed = ", ".join(f"'{m}'" for m in markers)
    return f"SELECT DISTINCT c.column_urn FROM {{column_marks}} c JOIN {{{marks}}} m ON m.column_urn = c.column_urn AND m.marker_urn <> c.marker_urn WHERE c.marker_urn IN ({listed})"


PARTS = {
    "found_paths": " UNION ALL ".join(f"SELECT '{kind}' AS finding_type, root, path, ancestor FROM {{{m}_matches}}" for kind, m in ROOTS.items()),
    "found_marks": " UNION ALL ".join(f"SELECT '{kind}' AS finding_type, column_urn FROM {{{m}_marks}}" for kind, m in ROOTS.items()),
    "next_label": next_sql("label_marks", LABEL),
    "next_class": next_sql("class_marks", PII, SECRET, AGE, GENDER),
    "next_protected": next_sql("protected_marks", AGE, GENDER),
    "next_marks": " UNION ALL ".join(f"SELECT '{kind}' AS finding_type, column_urn FROM {{next_{m}}}" for kind, m in ROOTS.items()),
    "first_edges": """SELECT DISTINCT finding_type, root, path[1] AS src, path[2] AS dst FROM {found_paths} f
        WHERE len(path) > 1 AND NOT EXISTS (SELECT 1 FROM {found_paths} o WHERE o.finding_type = f.finding_type AND o.root = f.root AND len(o.path) = 1)""",
    "edges_out": """SELECT finding_type, root, 'cut_edge' AS remedy, src || '<-' || dst AS target, src, dst FROM {first_edges}
        UNION ALL SELECT finding_type, root, 'cut_all', '*', src, dst FROM {first_edges}""",
    "tried": """SELECT DISTINCT finding_type, root, remedy, target FROM {edges_out}
        UNION ALL SELECT DISTINCT finding_type, root, 'remove_mark', ancestor FROM {found_paths}""",
    "recursive_whatif": """SELECT t.*, [t.root] AS path, t.root AS node, 0 AS hops,
            CASE WHEN t.remedy = 'remove_mark' AND t.target = t.root THEN n.column_urn IS NOT NULL ELSE m.column_urn IS NOT NULL END AS halt
        FROM {tried} t LEFT JOIN {found_marks} m ON m.finding_type = t.finding_type AND m.column_urn = t.root LEFT JOIN {next_marks} n ON n.finding_type = t.finding_type AND n.column_urn = t.root
        UNION ALL SELECT w.finding_type, w.root, w.remedy, w.target, list_append(w.path, e.dst), e.dst, w.hops + 1,
            CASE WHEN w.remedy = 'remove_mark' AND w.target = e.dst THEN n.column_urn IS NOT NULL ELSE m.column_urn IS NOT NULL END
        FROM {recursive_whatif} w JOIN {up_edges} e ON e.src = w.node
        LEFT JOIN {edges_out} o ON o.finding_type = w.finding_type AND o.root = w.root AND o.remedy = w.remedy AND o.target = w.target AND o.src = e.src AND o.dst = e.dst
        LEFT JOIN {found_marks} m ON m.finding_type = w.finding_type AND m.column_urn = e.dst LEFT JOIN {next_marks} n ON n.finding_type = w.finding_type AND n.column_urn = e.dst
        WHERE NOT w.halt AND w.hops < 6 AND NOT list_contains(w.path, e.dst) AND o.root IS NULL""",
    "path_counts": "SELECT finding_type, root, count(*) AS paths FROM {found_paths} GROUP BY ALL",
    "walked": """SELECT t.finding_type, t.root, t.remedy, t.target, p.paths, coalesce(w.n, 0) AS paths_left FROM {tried} t
        JOIN {path_counts} p ON p.finding_type = t.finding_type AND p.root = t.root
        LEFT JOIN (SELECT finding_type, root, remedy, target, count(*) AS n FROM {recursive_whatif} WHERE halt GROUP BY ALL) w
        ON w.finding_type = t.finding_type AND w.root = t.root AND w.remedy = t.remedy AND w.target = t.target""",
    "siblings": "SELECT model_urn, source, count(DISTINCT feature_urn) AS n FROM {linked} GROUP BY ALL",
}
RESULT = """
SELECT finding_type, model_urn, feature_urn, remedy, target, paths, paths_left, paths_left = 0 AS cleared FROM (
    SELECT w.finding_type, l.model_urn, l.feature_urn, w.remedy, w.target, w.paths, w.paths_left FROM {linked} l JOIN {walked} w ON w.root = l.source
    UNION ALL SELECT p.finding_type, l.model_urn, l.feature_urn, 'drop_feature', l.feature_urn, p.paths, CASE WHEN s.n > 1 THEN p.paths ELSE 0 END
        FROM {linked} l JOIN {path_counts} p ON p.root = l.source JOIN {siblings} s ON s.model_urn = l.model_urn AND s.source = l.source
    UNION ALL SELECT finding_type, model_urn, feature_urn, 'remove_mark', protected, 1, CASE WHEN protected IN (SELECT column_urn FROM {next_protected}) THEN 1 ELSE 0 END FROM {proxies}
    UNION ALL SELECT p.finding_type, p.model_urn, p.feature_urn, 'drop_feature', p.feature_urn, count(*), CASE WHEN any_value(s.n) > 1 THEN count(*) ELSE 0 END
        FROM {proxies} p JOIN {siblings} s ON s.model_urn = p.model_urn AND s.source = p.resource_urn GROUP BY p.finding_type, p.model_urn, p.feature_urn) x
"""


def remedies(a: Scored) -> DataFrame:
    kinds = {"target_leakage": (a.label_matches, (LABEL,)), "sensitive_source": (a.class_matches, (PII, SECRET, AGE, GENDER))}
    named = lambda df, kind: df.withColumn("finding_type", F.lit(kind))
    every = lambda f: f("target_leakage").unionByName(f("sensitive_source"))
    matches = every(lambda k: named(kinds[k][0], k))
    marks = every(lambda k: named(a.marks(*kinds[k][1]), k))
    after = every(lambda k: named(models.next_markers(a.t.column_marks, *kinds[k][1]), k))
    columns = whatif.column_remedies(a.linked, matches, a.t.column_lineage, marks, after, a.column_hops)
    return columns.unionByName(whatif.proxy_remedies(a.linked, a.proxies, models.next_markers(a.t.column_marks, AGE, GENDER)))


QUERIES["j36_verify_remedy"] = lambda spark, sf_dir: remedies(audit_of(spark, sf_dir))
SQL["j36_verify_remedy"] = oracle(RESULT, EVERY | PARTS)
