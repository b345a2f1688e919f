"""Whole jobs: algorithm runs, views over the test tables, registered queries and their SQL."""
