"""docketry: a Spark-first engine for corpora of court documents and their metadata."""
