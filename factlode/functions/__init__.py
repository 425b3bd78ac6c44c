"""Column functions: tokens, text, vectors, facts and identities."""
