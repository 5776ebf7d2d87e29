"""Registered queries by area, each with the SQL it is checked against where SQL can express it."""

from cairn.queries import analytics, corpus, platform, retrieval

QUERIES = {**retrieval.QUERIES, **corpus.QUERIES, **analytics.QUERIES, **platform.QUERIES}
SQL = {**retrieval.SQL, **corpus.SQL, **analytics.SQL, **platform.SQL}
