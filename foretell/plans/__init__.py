"""Registered queries, their SQL twins and command-line plans."""
