"""Operators of a training-data pipeline; :mod:`inlay.llm.queries` registers them."""
