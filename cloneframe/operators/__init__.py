"""DataFrame operators on clones and edges."""
