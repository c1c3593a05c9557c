"""Table discovery and feature augmentation as Spark plans."""
