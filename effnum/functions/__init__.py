"""Column functions: text, vectors and sounds, all evaluated inside the JVM."""

from . import sound, text, vector

__all__ = ["sound", "text", "vector"]
