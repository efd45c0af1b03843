"""Stored pipelines assembled from the operators."""
