"""Scalar plans and column expressions."""
