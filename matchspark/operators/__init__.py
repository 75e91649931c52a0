"""Operators from DataFrame to DataFrame, one module for each family."""
