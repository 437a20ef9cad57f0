"""Column expressions. All run inside the JVM; there is no Python UDF."""
