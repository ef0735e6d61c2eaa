"""Source-quality analytics as Spark jobs: corpus tables in, scored findings out."""
