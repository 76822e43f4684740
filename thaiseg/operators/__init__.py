"""Dictionaries, prefix lookup and the segmentation lattice."""
