"""Document values: canonical text, paths, coercion, merge and diff, and their Column functions."""
