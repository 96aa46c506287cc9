"""Registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from tallyreef.plans import boards, catalog, extraction, intake, master, naming, periods, scans, searches, shops, sites, statistics, storage, streams, timeline

FLAGSHIP = "win_rate_by_nation"
QUERIES: dict = {**statistics.QUERIES, **timeline.QUERIES, **catalog.QUERIES, **naming.QUERIES, **master.QUERIES, **periods.QUERIES, **extraction.QUERIES, **boards.QUERIES, **shops.QUERIES, **sites.QUERIES, **scans.QUERIES, **storage.QUERIES, **searches.QUERIES, **intake.QUERIES, **streams.QUERIES}
ORACLE_SQL: dict[str, str] = {**statistics.ORACLE_SQL, **timeline.ORACLE_SQL, **catalog.ORACLE_SQL, **naming.ORACLE_SQL, **master.ORACLE_SQL, **periods.ORACLE_SQL, **extraction.ORACLE_SQL, **boards.ORACLE_SQL, **shops.ORACLE_SQL, **sites.ORACLE_SQL, **scans.ORACLE_SQL, **storage.ORACLE_SQL, **searches.ORACLE_SQL, **intake.ORACLE_SQL, **streams.ORACLE_SQL}
