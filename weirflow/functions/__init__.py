"""Column functions: log positions, documents, fingerprints."""
