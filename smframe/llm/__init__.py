"""Operators for preparing training data; optional, and imported by nothing else in the library."""
