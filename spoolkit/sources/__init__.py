"""Readers and writers of transcripts, episodes and recorded results."""
