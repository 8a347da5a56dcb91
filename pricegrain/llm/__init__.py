"""Operators for training data on texts and listings; nothing else in the library imports this subpackage."""
