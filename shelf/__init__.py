"""Shelf: plan, check and apply the layout of large media collections with Spark."""
