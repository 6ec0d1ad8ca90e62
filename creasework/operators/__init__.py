"""Part of the analytics library."""
