"""Constants of the vector model and column functions."""
