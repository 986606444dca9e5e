"""textloom: document text processing on Spark."""
