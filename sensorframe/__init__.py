"""Analytics over timestamped signal readings, on Spark DataFrames."""
