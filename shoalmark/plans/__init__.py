"""Whole jobs: the assessment cycle, stand-in inputs and the registered queries."""
