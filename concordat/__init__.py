"""Concordat: inventory reconciliation and deduplication on PySpark."""
