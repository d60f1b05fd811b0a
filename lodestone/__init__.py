"""Lodestone: see README."""
