"""Column-level functions: window kernels, detection tests, severity, ids."""
