"""Column functions: column in, column out, within whole-stage code generation."""
