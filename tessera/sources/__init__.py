"""Readers and writers of alignment datasets, and the demonstration graphs."""
