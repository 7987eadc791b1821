"""All registered queries of the subpackage with their SQL forms."""

from modsift.llm import queries_exact, queries_models, queries_native, queries_near, queries_records, queries_vectors

QUERIES, SQL = {}, {}
for part in (queries_exact, queries_models, queries_native, queries_near, queries_records, queries_vectors):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
