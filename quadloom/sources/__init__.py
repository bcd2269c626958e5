"""Where quads and documents come from."""
