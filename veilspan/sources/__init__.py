"""Readers and writers for documents, vaults, transcripts, token files and stored responses."""
