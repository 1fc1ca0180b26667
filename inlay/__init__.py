"""Planned interventions on token corpora, and their evaluation, as Spark jobs."""
