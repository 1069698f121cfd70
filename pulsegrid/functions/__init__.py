"""Functions of the burst analytics engine."""
