"""The three user-level plans: validate, audit and index."""
