"""Whole analyses composed from the operators, and the query catalogue."""
