"""Event-log jobs: admission rules, rollups, carry-over. Batch and Structured Streaming share their rules."""
