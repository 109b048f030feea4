"""Functions of the skeinlake engine."""
