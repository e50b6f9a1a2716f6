"""Analytics over catalogs of large file trees, as Spark DataFrames."""
