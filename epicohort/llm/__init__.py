"""Operators for building a training corpus; nothing else in the library imports this subpackage."""
