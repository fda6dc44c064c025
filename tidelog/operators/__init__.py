"""Operators on a change log (key, seq, kind, value)."""
