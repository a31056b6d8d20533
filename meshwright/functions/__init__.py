"""Part of meshwright."""
