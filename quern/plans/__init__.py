"""Canonical views, registered queries and their SQL."""
