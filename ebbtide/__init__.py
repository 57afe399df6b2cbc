"""Attrition-risk analytics on Spark: panel preparation, features, selection, models, queue and reports."""
