"""Operators that prepare a training corpus.  Nothing outside this folder imports it."""
