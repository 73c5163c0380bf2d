"""Column functions over sequences, CIGAR strings, SAM fields and qualities."""
