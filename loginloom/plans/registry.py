"""All registered queries of the analytics engine and the SQL that they are compared with."""

from __future__ import annotations

from . import analysis_queries, detection_queries, incident_queries, ingest_queries, landing_queries, report_queries, study_queries

MODULES = (detection_queries, analysis_queries, ingest_queries, landing_queries, study_queries, report_queries, incident_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
