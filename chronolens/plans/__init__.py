"""Registered queries, each with the SQL it is checked against."""

from . import catalog, flagship, given, models

QUERIES = {**catalog.QUERIES, **flagship.QUERIES, **models.QUERIES}
ORACLES = {**catalog.ORACLES, **flagship.ORACLES}
