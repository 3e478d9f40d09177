"""Spark-native ledger analytics: operators, parsers, matching, drafts, evaluation and sources."""
