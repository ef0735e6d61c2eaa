"""Collects the registered queries of all query modules."""

from codequarry.plans import q_code, q_findings, q_intake, q_reports, q_streams  # noqa: F401
from codequarry.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
