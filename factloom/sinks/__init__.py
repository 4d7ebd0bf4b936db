"""Writers of what the library makes."""
