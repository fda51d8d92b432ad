"""Compositions of operators: the whole run and the registered queries."""
