"""Operators for large-scale training-data pipelines; nothing else in runlens imports this subpackage."""
