"""Column functions that stay inside the JVM, and two Arrow helpers."""
