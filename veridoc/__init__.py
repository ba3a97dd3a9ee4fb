"""Document regression on Spark: compare two large document sets as tables."""
