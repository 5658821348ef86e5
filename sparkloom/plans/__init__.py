"""Plans of sparkloom."""
