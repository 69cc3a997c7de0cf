"""Column-level functions built from JVM-side expressions."""
