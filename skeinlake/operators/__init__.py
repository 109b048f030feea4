"""Operators of the skeinlake engine."""
