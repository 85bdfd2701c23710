"""tidemark: a Spark-first engine for timed transcripts, claims and text collections."""
