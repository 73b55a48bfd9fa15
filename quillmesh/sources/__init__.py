"""Configuration and file-tree sources."""
