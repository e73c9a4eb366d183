"""Operators that prepare a language-model training corpus."""
