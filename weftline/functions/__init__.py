"""Column functions: native expressions first, Arrow-backed functions where a fold is sequential."""
