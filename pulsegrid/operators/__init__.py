"""Operators of the burst analytics engine."""
