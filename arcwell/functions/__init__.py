"""Part of the code-graph library."""
