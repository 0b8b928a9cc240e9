"""siltbed: content-addressed snapshot analytics on PySpark."""
