"""swathline: earth-observation analytics expressed as Spark DataFrames."""
