"""Array kernels in NumPy, run inside Arrow functions."""
