"""Readers and writers for payloads, dictionaries, synonyms and indexes."""
