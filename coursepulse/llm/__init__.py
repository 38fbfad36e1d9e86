"""Operators for preparing training text: sharding, scans, filters, tokenizers, duplicates."""
