"""Failure-triage analytics as Spark DataFrame jobs."""
