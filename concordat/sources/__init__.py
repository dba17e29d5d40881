"""Readers and writers of inventories, listings, snapshots and raw trees."""
