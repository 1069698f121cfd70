"""Sources of the burst analytics engine."""
