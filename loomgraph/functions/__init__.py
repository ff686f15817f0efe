"""Column functions: text, hashes, scores and vectors."""
