"""Operators for language-model training data; nothing else in the package imports this one."""
