"""The append-only receipt store, checked as it grows."""
