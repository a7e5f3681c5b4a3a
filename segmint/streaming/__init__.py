"""Micro-batch streams: running state, relays, enrichment (STM-*)."""
