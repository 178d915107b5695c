"""Operators for preparing training data from source code and project text."""
