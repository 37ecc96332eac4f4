"""Column expressions and the small numpy kernels that run inside Arrow tasks."""
