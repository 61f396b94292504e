"""Registered queries: each operator over the driver's tables, with its check in SQL."""
