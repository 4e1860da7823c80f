"""Decision-forest analytics on Spark: every operator is a DataFrame transformation."""
