"""Evaluation of scored-classification experiments as Spark jobs over tables."""

from siftmark.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
