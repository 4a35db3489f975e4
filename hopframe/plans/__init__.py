"""Whole plans: test tables, corpus builds, evaluation, registered queries."""
