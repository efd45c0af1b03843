"""Column expressions; every one stays in the JVM except Unicode compatibility folding."""
