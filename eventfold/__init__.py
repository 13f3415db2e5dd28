"""Keyed event folds on Spark: counts, chaser summaries and billing state."""
