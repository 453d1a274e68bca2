"""Recursive operators: fix-points and Datalog programs."""
