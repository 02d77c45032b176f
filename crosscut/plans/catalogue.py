"""All checked queries of the engine, those over findings and files before those over every line."""

from . import finding_queries, rule_queries, service_queries, source_queries

_MODULES = (service_queries, source_queries, finding_queries, rule_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: m.SQL[name] for m in _MODULES for name in m.QUERIES if name in m.SQL}
