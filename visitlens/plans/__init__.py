"""Whole jobs: read inputs, run the analyses of one task, write result tables."""
