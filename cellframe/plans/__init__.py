"""Rewrites of queries into cheaper ones."""
