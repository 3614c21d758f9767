"""Column functions; all but the product with one vector run inside the JVM."""
