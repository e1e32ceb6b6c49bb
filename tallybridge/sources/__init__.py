"""Files, catalog tables and JDBC databases as DataFrames, and back."""
