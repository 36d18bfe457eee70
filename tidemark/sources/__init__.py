"""Readers of symbol and relocation formats."""
