"""Streaming of sparkloom."""
