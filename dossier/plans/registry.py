"""All registered queries and their SQL. The training-text subpackage is added by __spark_entry__ only if it can be imported."""

from __future__ import annotations

from dossier.plans import general, papers

QUERIES = {**general.QUERIES, **papers.QUERIES}
SQL = {**general.SQL, **papers.SQL}
