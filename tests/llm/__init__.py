"""Tests of the optional subpackage."""
