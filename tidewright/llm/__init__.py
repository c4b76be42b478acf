"""Operators for preparing training text at corpus scale; nothing else in the library imports them."""
