"""Streaming of the burst analytics engine."""
