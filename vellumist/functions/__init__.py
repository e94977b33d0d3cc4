"""Part of vellumist; see README."""
