"""Metadata graph analytics over fleets of database catalogs, as Spark jobs."""
