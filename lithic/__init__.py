"""Snapshot tables and analytics on Spark."""

from .database import Database, Transaction, open_database

__all__ = ["Database", "Transaction", "open_database"]
