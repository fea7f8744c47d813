"""Analytic queries over the entity tables."""
