"""Readers and writers for attribute-value files and driver definitions."""
