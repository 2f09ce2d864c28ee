"""Operators on texts for training data; nothing outside of this subpackage imports it."""
