"""Part of meshloom."""
