"""Registered queries: the operators on tables derived from the test data.

Every query comes with independent SQL where SQL can express it.
"""
