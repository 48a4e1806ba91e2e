"""Relational building blocks that the questions share."""
