"""Whole jobs, views of plain tables as job data, and the registered queries."""
