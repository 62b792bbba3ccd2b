"""All queries of the subpackage and the SQL for those that SQL can express."""

from annalist.llm import bpe, chat, decontaminate, language, lm_score, periodic_runs, quality_classifier, quality_rules, run_index, sharding, simhash, spelling, tokencount

MODULES = (simhash, bpe, quality_rules, tokencount, lm_score, decontaminate, chat, language, quality_classifier, sharding, spelling, periodic_runs, run_index)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
