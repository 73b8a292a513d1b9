"""Column functions: text grammars, renderers, vectors."""
