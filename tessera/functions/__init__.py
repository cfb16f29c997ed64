"""Scalar functions: column expressions that stay in the JVM."""
