"""Operators for building training data at scale, one module each.

Nothing outside this subpackage imports it.
"""
