"""Tabulation, reconciliation and seat apportionment as Spark jobs."""
