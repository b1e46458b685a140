"""spoolkit: a Spark-first analytics engine for agent traces and training corpora."""
