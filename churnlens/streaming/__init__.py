"""Structured Streaming: incremental cleaning of arriving customer-record files."""
