"""Metrics: each function composes operators into one lazy plan."""
