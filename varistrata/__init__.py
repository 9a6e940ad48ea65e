"""Cohort multivariate analytics expressed as Spark DataFrame plans."""
