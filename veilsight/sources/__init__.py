"""Readers and writers of the tables in veilsight.schemas."""
