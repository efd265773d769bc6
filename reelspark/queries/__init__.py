"""The driver's queries over the retrieval operators, with their SQL."""

from . import clips, names, vectors

QUERIES = vectors.QUERIES | clips.QUERIES | names.QUERIES
ORACLE_SQL = vectors.ORACLE_SQL | clips.ORACLE_SQL | names.ORACLE_SQL
