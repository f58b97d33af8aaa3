"""Scans, dataset preparation and sinks."""
