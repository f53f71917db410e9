"""Queries over the given tables, and the SQL that checks them."""

from . import addresses, datasets, functions, roads, search, sources, streams

MODULES = [addresses, functions, datasets, search, roads, sources, streams]
