"""Hybrid retrieval, ingestion and access policy for document collections, as Spark plans."""
