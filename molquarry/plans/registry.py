"""All registered queries of the structure operators."""

from __future__ import annotations

from . import analysis, database, further, more, patterns

QUERIES = {**patterns.QUERIES, **database.QUERIES, **analysis.QUERIES, **more.QUERIES, **further.QUERIES}
ORACLE = {**patterns.ORACLE, **database.ORACLE, **analysis.ORACLE, **more.ORACLE, **further.ORACLE}
