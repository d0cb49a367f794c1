"""Column functions: pure expressions that stay inside generated code."""
