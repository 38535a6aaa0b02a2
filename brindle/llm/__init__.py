"""Operators for text collections that language models are trained on. Nothing outside
this package imports it."""
