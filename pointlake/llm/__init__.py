"""Operators for building training corpora: filters, extraction, deduplication, packing and tokenisation."""
