"""Column functions. They are made of built-in expressions and run inside the JVM."""
