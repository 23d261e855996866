"""Operators for building training corpora: ten jobs over tables of documents, and their queries."""
