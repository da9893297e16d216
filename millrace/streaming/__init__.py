"""Structured Streaming forms: stateful processors and micro-batch jobs."""
