"""The query catalogue: DataFrame plans beside the SQL that checks them."""
