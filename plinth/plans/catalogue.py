"""All queries of the library by name, and the SQL of those that SQL expresses."""

from plinth.plans import footprints, polygons, tables

_ALL = footprints.QUERIES | tables.QUERIES | polygons.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
