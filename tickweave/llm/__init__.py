"""Operators for preparing training text: scores, filters, joins, encodings, archives and packing."""
