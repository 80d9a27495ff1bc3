"""Operators for preparing training data; each docstring states its result in the odd cases."""
