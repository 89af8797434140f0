"""Operators on text for model training data. Nothing else in the library imports this subpackage."""
