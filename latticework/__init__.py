"""Panel analytics for cross-sectional factor research, on Spark DataFrames."""
