"""A Spark engine for building, searching and evaluating a text corpus."""
