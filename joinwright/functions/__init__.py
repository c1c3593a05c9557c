"""Column functions: key normal forms, text, similarity, arrays, tolerant JSON."""
