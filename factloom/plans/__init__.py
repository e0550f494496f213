"""Whole queries built from the operators, with SQL that must give the same rows."""
