"""Readers, writers and the result cache."""
