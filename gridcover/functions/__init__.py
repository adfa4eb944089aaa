"""Part of gridcover."""
