"""Analyzers: a file's text in, drafts of entities, relationships and messages out."""
