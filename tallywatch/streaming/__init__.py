"""Structured Streaming: scoring of incoming transactions and velocities across micro-batches."""
