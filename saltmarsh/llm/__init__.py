"""Training-data operators: de-duplication, scoring, mixing and packing of text tables."""
