"""Column expressions: vectors, triangles, tetrahedra, intervals, Morton codes, kernels."""
