"""Structured Streaming: continuous import of test reports and commits."""
