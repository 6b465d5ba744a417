"""Readers with declared schemas and the sinks that go with them."""
