"""Column and NumPy functions on vectors: norms, packing, hypercomplex and geometric algebra."""
