"""Program-dataflow and text analytics on Spark DataFrames."""
