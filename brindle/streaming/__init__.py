"""The request protocol, the service loop, and its Structured Streaming replay."""
