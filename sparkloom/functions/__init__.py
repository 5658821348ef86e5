"""Functions of sparkloom."""
