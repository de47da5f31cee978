"""Part of quiverlake."""
