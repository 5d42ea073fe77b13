"""Operators on the texts of training data; nothing outside this subpackage imports it."""
