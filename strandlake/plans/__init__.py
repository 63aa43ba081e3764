"""Whole plans: panel preparation, imputation, scoring, the command line and the query catalogue."""
