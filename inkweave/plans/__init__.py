"""Compositions of the operators, and the query catalog with its SQL counterparts."""
