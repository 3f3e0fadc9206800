"""Strictly-prior feature, rating, model and evaluation operators."""
