"""Column functions: counter-based randomness, copy-number profiles, multisets and staged tables."""
