"""Vector operators over DataFrames."""
