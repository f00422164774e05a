"""Query operators over measurements, series, rules and messages."""
