"""Readers: from repository files to typed fact tables."""
