"""Leakage-free match analytics and training-data operators on Spark."""
