"""Operators for text corpora used to train language models. Nothing else in the library imports this."""
