"""Registered queries: adapted inputs, operators, oracles."""
