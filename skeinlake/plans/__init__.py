"""Plans of the skeinlake engine."""
