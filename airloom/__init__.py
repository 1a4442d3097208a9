"""airloom: sensor time-series measurement analytics on Spark DataFrames."""
