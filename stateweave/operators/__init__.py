"""Distributed operators: adaptation, encoding, statistics, ranking and solvers."""
