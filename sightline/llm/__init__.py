"""Operators for training-data pipelines, and the queries that apply them."""

from sightline.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
