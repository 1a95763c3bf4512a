"""Operators on texts. Nothing outside this subpackage imports it."""
