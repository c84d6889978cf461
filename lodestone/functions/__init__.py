"""Column functions: text, tokens, vectors, audit and decision rules."""
