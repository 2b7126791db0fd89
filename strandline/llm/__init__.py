"""Operators for preparing training data at scale, with their queries. Nothing else in the library imports this."""
