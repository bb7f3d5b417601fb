"""Operators for building training corpora, each usable on its own; nothing outside this subpackage imports it."""
