"""Readers and writers: board pages, sheet exports, snapshots, event captures, bridge tables."""
