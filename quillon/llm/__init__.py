"""Operators that prepare training data for language models. Nothing else in this library imports this subpackage."""
