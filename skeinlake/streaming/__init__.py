"""Streaming of the skeinlake engine."""
