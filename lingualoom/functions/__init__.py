"""Column expressions: everything here is a built-in Spark expression unless the name says Arrow."""
