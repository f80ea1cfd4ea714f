"""Filter language, distances and scalar helpers that compile to Spark columns."""
