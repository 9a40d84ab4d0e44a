"""Registered queries: importing this package fills the registry."""
from . import hospital_queries, inference_queries, model_queries, patient_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
