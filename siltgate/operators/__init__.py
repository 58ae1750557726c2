"""Part of siltgate."""
