"""Readers that turn files into rows, documents and pairs."""
