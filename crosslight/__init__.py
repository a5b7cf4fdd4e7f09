"""Cross-vendor request correlation and analytics on Spark DataFrames."""
