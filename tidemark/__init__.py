"""Shoreline-change analytics as Spark DataFrame programs."""
