"""Spark-native building blocks for document collections: ingest, chunk, index, retrieve, answer, evaluate."""
