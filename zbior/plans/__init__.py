"""Named queries, and for each that SQL can express, the SQL that must give the same rows."""

from zbior.plans import catalog, core_problems, relational

QUERIES = {**catalog.QUERIES, **relational.QUERIES, **core_problems.QUERIES}
SQL = {**catalog.SQL, **relational.SQL}
