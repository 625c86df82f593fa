"""Document-record analytics on Spark: every operator is a DataFrame transformation."""
