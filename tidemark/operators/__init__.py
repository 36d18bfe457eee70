"""Relational operators of version alignment: frames in, frames out."""
