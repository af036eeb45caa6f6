"""PySpark jobs over text corpora, scores, vectors and run records."""
