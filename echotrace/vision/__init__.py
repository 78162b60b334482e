"""Pixel kernels in NumPy, page features and pair checks of pictures."""
