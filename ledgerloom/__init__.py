"""Temporal transaction-graph analytics and corpus preparation on Spark."""
