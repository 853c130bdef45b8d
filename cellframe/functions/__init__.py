"""Column functions: key encodings, bit and Z-order functions, distance metrics."""
