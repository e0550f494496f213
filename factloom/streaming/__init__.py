"""Stateful operators over an unbounded job queue."""
