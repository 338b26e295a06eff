"""Operators on text and entities for training-data pipelines; nothing else in the library imports this subpackage."""
