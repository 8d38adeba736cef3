"""pagemill: HTML tokenization, trees and sanitizing as Spark DataFrame operators."""

__version__ = "0.1.0"
