"""Relational operators over offers, dictionaries, postings and logs."""
