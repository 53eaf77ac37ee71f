"""Training-data operators. Nothing outside this subpackage imports it, except the guarded entry point."""
