"""Operators for large text corpora. Nothing else in permeate imports this subpackage."""
