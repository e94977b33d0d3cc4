"""All queries over the driver's tables by name, with the same results in SQL."""

from . import boxes, corpus, files, pages, selection, texts

QUERIES: dict = texts.QUERIES | boxes.QUERIES | pages.QUERIES | corpus.QUERIES | selection.QUERIES | files.QUERIES
SQL: dict = texts.SQL | boxes.SQL | pages.SQL | corpus.SQL | selection.SQL | files.SQL
FLAGSHIP = "text_summary_by_role"
