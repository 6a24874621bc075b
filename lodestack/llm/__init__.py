"""Operators for text that feeds language models; nothing else in the library imports this subpackage."""
