"""Canonicalisation, evaluation, experiments, harvest, cost and reports over DataFrames."""
