"""Training-data operators.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames, keeps unbounded data on the executors and cuts lineage only through
tables written to the folder named by ``spark.checkpoint.dir``.
"""
