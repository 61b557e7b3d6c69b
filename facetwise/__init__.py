"""Spark operators for understanding tables: profile, relate, chart, model, search."""
