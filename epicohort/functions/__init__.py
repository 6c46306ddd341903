"""Column-expression builders (JVM-side, codegen friendly; no Python UDFs)."""
