"""Whole dataflows: scan, verify, compare, and their reports."""
