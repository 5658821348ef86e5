"""Sources of sparkloom."""
