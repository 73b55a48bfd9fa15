"""Continuous re-validation (an extension)."""
