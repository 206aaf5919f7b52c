"""Column functions: sizes as text, fingerprints, path text."""
