"""Readers of landed feeds and sinks of tables. Feeds are read with explicit schemas."""
