"""Readers and writers for capture dumps, spooled readings and history tables."""
