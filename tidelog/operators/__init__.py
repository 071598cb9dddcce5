"""DataFrame in, DataFrame out: parsing, pairing, rollups, error groups, alerts, diagnostics."""
