"""Queries over the driver's tables, and the SQL that each is held against."""

from . import analytics, basics, inspection, linking, records, tables_built

FLAGSHIP = "fuzzy_link_topk"
_ALL = linking.QUERIES | analytics.QUERIES | inspection.QUERIES | records.QUERIES | tables_built.QUERIES | basics.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
