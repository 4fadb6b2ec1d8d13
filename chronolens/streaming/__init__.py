"""Streams of series: beyond the batch operators, but the same code.

The transform and a fitted model are stateless per row, so they apply to a
streaming DataFrame as they are.
"""
