"""Operators for preparing training text: scans, labels, fingerprints, duplicates and tokens."""
