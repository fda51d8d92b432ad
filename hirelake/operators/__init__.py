"""Relational operators over postings, payloads, pages and model tables."""
