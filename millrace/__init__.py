"""A Spark-first engine for building, cleaning, splitting and scoring training corpora."""
