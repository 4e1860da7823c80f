"""Materialisation and execution helpers shared by the operators."""
