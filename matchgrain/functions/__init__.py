"""Subpackage of matchgrain."""
