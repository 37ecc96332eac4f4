"""Readers and writers: vector tables, run tables, query logs, stored indexes."""
