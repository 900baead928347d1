"""Table-scale evaluation of model answers on Spark.

Every operator takes DataFrames and returns DataFrames. Plans stay lazy except where
an operator says that it stages rows in the shared checkpoint folder.
"""
