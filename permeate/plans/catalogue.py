"""All queries of the core and their SQL."""

from permeate.plans import core_problems, reference_queries

QUERIES = {**reference_queries.QUERIES, **core_problems.QUERIES}
ORACLE = {**reference_queries.ORACLE, **core_problems.ORACLE}
FLAGSHIP = "rag_prompts"
