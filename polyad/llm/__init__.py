"""Operators for corpora and large item sets. Nothing outside this subpackage imports it."""
