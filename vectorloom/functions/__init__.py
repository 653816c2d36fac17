"""Kernels on vectors: codebooks, rotation, packing, quantisation, estimation."""
