"""Readers, writers and the tag ontology."""
