"""Readers and writers: CSV extracts, prepared tables and the supplied test tables."""
