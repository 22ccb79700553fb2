"""Readers and writers: archives, lists, registry documents, state tables."""
