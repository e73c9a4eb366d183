"""tidelex: search analytics and corpus preparation on Spark DataFrames."""
