"""Column functions: costs, digests, normalisers."""
