"""Numpy kernels that run inside grouped tasks, where an operation is raster-shaped or sequential."""
