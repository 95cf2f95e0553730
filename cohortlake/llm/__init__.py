"""Training-data operators: formatting, token counts, scans, scoring, mixing, sharding, dedup.

Nothing else in the library imports this subpackage. Every operator takes and returns
DataFrames; the contract queries over the driver's tables are in ``queries``.
"""
