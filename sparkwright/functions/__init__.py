"""Part of sparkwright."""
