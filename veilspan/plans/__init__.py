"""Distributed building blocks and the query registry."""
