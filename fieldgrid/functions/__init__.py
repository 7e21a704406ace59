"""Column functions: reproducible draws and the geometry of regions."""
