"""Streaming variants; extensions, as the batch operators have no stream of their own."""
