"""Operators for preparing training text: packing, deduplication, filtering, scanning, extraction."""
