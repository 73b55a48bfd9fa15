"""quillmesh: a Spark-first analytics engine for Markdown knowledge bases."""

__version__ = "0.1.0"
