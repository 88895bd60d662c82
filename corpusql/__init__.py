"""corpusql: retrieval and corpus-analytics jobs on PySpark DataFrames."""
