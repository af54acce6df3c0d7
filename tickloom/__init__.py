"""tickloom: timing analysis and time-series cleaning of event tables on Spark DataFrames."""
