"""Operators over segments, files and job metadata."""
