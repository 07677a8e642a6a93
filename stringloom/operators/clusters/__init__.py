"""Six ways to group strings; each returns (id, label, is_noise, cluster)."""
