"""Training-data operators over text corpora (self-contained: nothing else in the package imports this)."""
