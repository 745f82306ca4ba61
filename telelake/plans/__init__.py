"""Skew-safe building blocks shared by the operators."""
