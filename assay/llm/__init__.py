"""Operators on vectors, sketches and texts for training-data work. Nothing outside this folder imports it."""
