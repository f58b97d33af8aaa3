"""Bounded queues, staleness, replay buffers, stepwise metrics and rate limits."""
