"""Table and metadata sources, catalog and sinks."""
