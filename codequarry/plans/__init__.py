"""Whole jobs and registered queries, built from the operators."""
