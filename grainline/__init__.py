"""Semantic analytics on Spark: metrics by dimensions with filters, lowered to DataFrame plans."""
