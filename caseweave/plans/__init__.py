"""Whole queries: discovery, cohorts, datasets and grading."""
