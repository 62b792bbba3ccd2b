"""Functions of text: columns that run in the JVM, and a few Arrow functions for byte arithmetic."""
