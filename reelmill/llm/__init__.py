"""Operators that prepare training text at cluster scale. Nothing else in the library imports this subpackage."""
