"""Operators for preparing training text: near copies, packing, extraction, scoring, filters."""
