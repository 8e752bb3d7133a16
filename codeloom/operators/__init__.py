"""Relational building blocks: resolution and traversal."""
