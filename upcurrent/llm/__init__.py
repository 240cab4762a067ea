"""Operators that prepare texts for training language models. Nothing outside this package imports it."""
