"""folioscope: linked-metadata analytics on Spark DataFrames."""
