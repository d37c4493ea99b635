"""Scalar Column functions: text normalisation, tokenising, tolerant JSON."""
