"""Composed plans: the reconciliation builder and the query catalogue."""
