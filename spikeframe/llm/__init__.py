"""Operators over a training corpus: cleaning, de-duplication, privacy, packing, tokens, language.

Nothing else in the library imports this subpackage.
"""
