"""Relational operators over observations, vectors, features and places."""
