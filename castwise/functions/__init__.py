"""Column expressions (JVM-side, codegen'd). No Python UDF lives here."""
