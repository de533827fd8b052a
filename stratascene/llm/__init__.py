"""Operators that prepare training text at corpus scale. Nothing else in the library imports this subpackage."""
