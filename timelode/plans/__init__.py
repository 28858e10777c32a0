"""Whole jobs, test-table adapters and the registered queries."""
