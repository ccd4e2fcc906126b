"""Estimators: plans that aggregate in Spark and solve what is small in numpy."""
