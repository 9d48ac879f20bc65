"""Column functions: identities, text, numbers."""
