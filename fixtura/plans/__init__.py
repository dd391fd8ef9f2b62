"""Compositions of operators: the panel, its export, and the registered queries."""
