"""Column builders: small, document-local, JVM-side expressions."""
