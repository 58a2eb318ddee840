"""Registered queries over the given tables."""

from tidemark.workload import (distribution_queries, encoder_queries, listing_queries, live_queries, model_queries,  # noqa: F401
                               policy_queries, stream_queries)
from tidemark.workload.base import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
