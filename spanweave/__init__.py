"""Spark jobs for interval-overlap and sequence-graph analytics."""
