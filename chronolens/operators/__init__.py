"""Operators over labelled series."""
