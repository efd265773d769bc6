"""Column functions: vectors, frames and names."""
