"""Operators for text corpora that train language models. Nothing outside this subpackage imports it."""
