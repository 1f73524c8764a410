"""Readers and writers of documents and indexes."""
