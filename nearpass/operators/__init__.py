"""Operators: keyed picks, z-scores, change detection, lookups, matching."""
