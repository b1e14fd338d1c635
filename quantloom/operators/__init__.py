"""Joins, enrichment, analytics, simulation and research as DataFrame operators."""
