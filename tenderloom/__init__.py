"""Spark-native analytics over tenders, bids, evaluations and their ledger.

Every public function maps DataFrames to DataFrames (or Columns to Columns) and
holds no state; a ``SparkSession`` is only taken where data is read.
"""
