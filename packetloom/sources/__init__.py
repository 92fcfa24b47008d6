"""Readers and writers: tables, CSV, JSON, event records, packet captures, sessions."""
