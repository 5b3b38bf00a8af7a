"""Composed analyses and plan inspection."""

from . import analyses, inspect

__all__ = ["analyses", "inspect"]
