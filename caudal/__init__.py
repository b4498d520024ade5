"""A Spark-first engine for learning-commerce analytics and text corpora."""
