"""Operators over documents, spans, utterances, frames and tokens."""
