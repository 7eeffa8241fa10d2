"""loomtext: a Spark-first engine for curating and evaluating labelled text."""
