"""Column expressions and the segmentation function."""
