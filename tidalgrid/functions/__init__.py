"""Column functions: globs, comparisons, templates."""
