"""Readers and writers of corpora, result tables and artifacts."""
