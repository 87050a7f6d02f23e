"""Results over HTTP."""
