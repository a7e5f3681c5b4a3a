"""Projections, lookups and joins, aggregations (PRJ-*, JOIN-*, AGG-*)."""
