"""Scalar functions and arithmetic as JVM-side column expressions."""
