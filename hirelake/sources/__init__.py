"""Readers, writers and tables the operators work from."""
