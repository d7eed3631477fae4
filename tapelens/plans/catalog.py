"""Imports every module that registers queries."""

from tapelens.plans import audits, evaluation, features, graph, ingest, memory, streams, teams  # noqa: F401
from tapelens.plans.registry import QUERIES, compose  # noqa: F401
