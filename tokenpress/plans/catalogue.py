"""All queries on the library's own operators, by name, and the SQL that checks them."""

from . import derived, records, texts

QUERIES: dict = texts.QUERIES | records.QUERIES | derived.QUERIES
ORACLE_SQL: dict[str, str] = texts.ORACLE_SQL | records.ORACLE_SQL | derived.ORACLE_SQL
