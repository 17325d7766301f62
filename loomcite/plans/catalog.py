"""All registered queries."""

from __future__ import annotations

from . import concept_plans, lineage_plans, project_plans, record_plans, stream_plans, text_plans, view_plans  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
