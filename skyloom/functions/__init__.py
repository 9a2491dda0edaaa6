"""Column functions: filter grammar, spherical geometry, special functions, scores, time and photometry."""
