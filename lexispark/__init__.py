"""lexispark: a Spark-first analytics engine for multi-label text coding."""
