"""Registered queries with their SQL twins."""

from .base import REGISTRY
from . import q_corpus, q_findings, q_history, q_invariants, q_observe, q_ops, q_plans, q_risk, q_rules, q_sca, q_stream

__all__ = ["REGISTRY"]
