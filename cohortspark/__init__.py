"""Cohort building, phenotyping and descriptive epidemiology as Spark DataFrame operators."""
