"""Registered queries over the given tables, each with its SQL twin where SQL can express it."""

from workload import (  # noqa: F401
    chunk_queries, log_queries, page_queries, retrieval_queries, text_queries, url_queries,
)
from workload.base import QUERIES, SQL  # noqa: F401
