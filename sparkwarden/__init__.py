"""Source-code audit analytics as Spark jobs over tables of files, commits, lockfiles and advisories."""

__version__ = "0.1.0"
