"""Readers for the clinical tables and for answer records; writers for datasets and reports."""
