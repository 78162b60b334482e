"""Research-data reuse analytics on PySpark."""
