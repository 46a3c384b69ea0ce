"""Relational operators of the ledger: lookups, paging, summaries, relations, mutations, ingest rules, hash matching."""
