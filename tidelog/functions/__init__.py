"""Byte-level key functions and codecs."""
