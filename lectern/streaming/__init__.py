"""Structured Streaming: sessions cut at quiet places, and transcripts with settled and open text."""
