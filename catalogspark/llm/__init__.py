"""Operators for large training-data corpora: de-duplication, quality, extraction, mixing and packing.

Nothing else in the library imports this subpackage."""
