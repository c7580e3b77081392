"""Part of the metaloom engine."""
