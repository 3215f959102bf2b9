"""Compositions of operators: resolver runs, the test-table adapter and the registered queries."""
