"""Column -> Column functions. All built from JVM-side expressions; no UDFs."""
