"""Analyses composed of several operators: table profiles, findings, question tables."""
