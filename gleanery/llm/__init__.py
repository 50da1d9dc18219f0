"""Operators over text and vectors for training data. Nothing outside this subpackage imports it."""
