"""Operators for preparing training corpora: near-duplicates, filters, mixing, packing, media."""
