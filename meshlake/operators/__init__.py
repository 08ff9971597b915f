"""DataFrame operators of the mesh engine."""
