"""Readers and writers: delivery table, feature pages, dumps, GeoJSON, reports."""
