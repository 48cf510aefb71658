"""DataFrame operators: codec, search and evaluation."""
