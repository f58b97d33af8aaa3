"""Rollout analytics on Spark: scans, scoring, grouped normalisation, metrics, curation, streams."""
