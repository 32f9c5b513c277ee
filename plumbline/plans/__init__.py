"""Whole assessments, and the registered queries over the test tables."""
