"""Corpus analytics on Spark DataFrames: scans, filters, deduplication, allocation, mixing, retrieval and reports."""
