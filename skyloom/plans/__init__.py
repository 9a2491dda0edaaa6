"""Named recipes over archives."""
