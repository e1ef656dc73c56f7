"""The registered queries, each with the SQL that checks it."""

from tidemark.plans import event_time, matches, relational, sketched, streams
from tidemark.plans.query import Query


def all_queries() -> list[Query]:
    return [*relational.QUERIES, *event_time.QUERIES, *matches.QUERIES, *sketched.QUERIES, *streams.QUERIES]
