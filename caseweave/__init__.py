"""Clinical cohort queries on Spark: discovery, cohorts, datasets and grading."""

from caseweave.schema import TABLES, Tables

__all__ = ["TABLES", "Tables"]
