"""Composed jobs: detection over tables, alert building, the query catalog."""
