"""Operators of sparkloom."""
