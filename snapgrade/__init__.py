"""Snapshot change capture, rule grading, drift and nearest-reference search as Spark jobs."""
