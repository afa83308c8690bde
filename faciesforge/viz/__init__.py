"""Pictures of results: colour ramps, image differences and SVG maps. None of this needs more than NumPy."""
