"""Column functions: identifiers, attempt outcomes, engine readings."""
