"""Operators: every function takes and returns DataFrames.

``by`` names extra key columns (species, model, scenario, ...).  Without it an
operator works on one stock, with it on all of them in one job.
"""
