"""Operators for training-data pipelines. Nothing else in meshloom imports this subpackage."""
