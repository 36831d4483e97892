"""Column functions: text, vectors and prompts."""
