"""Event-driven parts as Structured Streaming jobs; each also runs on a batch frame."""
