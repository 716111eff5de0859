"""Operators over documents and source texts for training data; nothing else in the package imports them."""
