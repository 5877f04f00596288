"""Projectors: source files of a language to their declarations."""
