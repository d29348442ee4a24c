"""All queries over the given tables, with their SQL twins."""

from __future__ import annotations

from auditspark.plans import audits, cleaning, records, scoring, studies

QUERIES: dict = {**audits.QUERIES, **cleaning.QUERIES, **studies.QUERIES, **records.QUERIES, **scoring.QUERIES}
ORACLE_SQL: dict[str, str] = {**audits.ORACLE_SQL, **cleaning.ORACLE_SQL, **studies.ORACLE_SQL, **records.ORACLE_SQL, **scoring.ORACLE_SQL}
