"""Streaming: scanning a drop directory as files arrive."""
