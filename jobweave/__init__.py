"""Labour-market data engine on Spark DataFrames."""
