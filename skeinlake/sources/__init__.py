"""Sources of the skeinlake engine."""
