"""Operators for LLM training data.  Nothing outside this subpackage imports it."""
