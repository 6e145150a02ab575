"""Imports every plan module so that its queries are registered."""

from sessionloom.plans import bursts, coverage, documents, enrichment, joins, key_queries, models, planning, provider_queries, request_queries, segmentation, thread_queries, trace, unified_queries, values  # noqa: F401
from sessionloom.plans.base import ORACLES, QUERIES  # noqa: F401
