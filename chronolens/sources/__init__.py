"""Sources of labelled series."""
