"""Cohort, call, lab and code operators over DataFrames."""
