"""Operators for preparing training text: deduplication, scans, mixing, rules, token files.

Nothing else in the library imports this subpackage.
"""
