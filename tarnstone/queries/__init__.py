"""Queries over the test tables, each bound to the operators it shows and, where possible, to equal SQL."""
