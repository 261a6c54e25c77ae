"""notemill: note capture, routing and evaluation as Spark DataFrame transforms."""

__version__ = "0.1.0"
