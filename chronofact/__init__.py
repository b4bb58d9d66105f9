"""Time-aware fact analytics on Spark: lazy DataFrame operators over facts with validity intervals."""
