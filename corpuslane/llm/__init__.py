"""Operators that prepare large text collections for training; see queries.py for their registered forms."""
