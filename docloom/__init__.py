"""docloom: document analytics on Spark, as plain functions from DataFrame to DataFrame."""
