"""Operators for preparing text for language-model training; nothing else in the library imports them."""
