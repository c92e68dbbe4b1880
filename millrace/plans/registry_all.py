"""Importing this module registers every query."""

from millrace.plans import (  # noqa: F401
    account_queries,
    billing_queries,
    collection_queries,
    document_queries,
    function_queries,
    file_queries,
    further_queries,
    log_queries,
    privacy_queries,
    relational_queries,
    session_queries,
    streaming_queries,
    text_queries,
    timer_queries,
    wire_queries,
)
