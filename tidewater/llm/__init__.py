"""Operators for large-scale training-data pipelines. Nothing outside of this subpackage imports it."""
