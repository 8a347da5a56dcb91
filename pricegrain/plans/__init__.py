"""Registered queries: name -> (spark, folder) -> DataFrame, with SQL that DuckDB can run beside them."""
