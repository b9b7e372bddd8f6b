"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps intermediate tables in the folder named by
``spark.checkpoint.dir`` and never gathers a table that grows with the input
on the driver.
"""
