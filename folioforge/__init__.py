"""Document-corpus analytics on PySpark."""
