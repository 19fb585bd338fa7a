"""Column expressions. Everything here stays in the JVM: no Python UDFs."""
