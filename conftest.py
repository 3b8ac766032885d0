"""Makes the package importable when tests run from the repository root."""
