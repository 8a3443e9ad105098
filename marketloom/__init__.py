"""Spark-native market-signal and event analytics.

Every operator takes and returns DataFrames; nothing runs until the caller acts on the result,
except where a docstring says so (model solves and the clustering rounds).
"""
