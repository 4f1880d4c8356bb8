"""The registered queries, each with the SQL that checks it."""

from poolwright.plans import channel_queries, log_queries, property_queries, scalar_queries, service_queries, stream_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (log_queries, channel_queries, scalar_queries, property_queries, service_queries, stream_queries):
    QUERIES |= _module.REGISTERED.queries
    ORACLE |= _module.REGISTERED.sql
