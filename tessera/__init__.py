"""A property-graph and search analytics engine on Spark DataFrames."""
