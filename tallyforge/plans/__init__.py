"""Whole jobs built from the operators: checks, simulation, comparison."""
