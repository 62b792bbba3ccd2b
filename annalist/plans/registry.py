"""All queries of the library and the SQL for those that SQL can express."""

from annalist.plans import finding, ingest, scalars, upkeep

MODULES = (scalars, finding, ingest, upkeep)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
