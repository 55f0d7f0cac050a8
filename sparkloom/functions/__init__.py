"""Part of sparkloom; see README.md for the layout."""
