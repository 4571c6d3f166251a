"""Whole jobs: load, extraction, reports, map export, and the registered queries."""
