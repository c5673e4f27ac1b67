"""Spark jobs that test whether observed mutations cluster more tightly than chance."""
