"""Content-addressed, versioned object data as Spark DataFrames."""
