"""sieveline: corpus checks, clone detection, coverage scoring and reports as Spark DataFrames."""
