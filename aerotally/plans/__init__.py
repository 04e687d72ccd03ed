"""Query bindings: which operator runs over which table, with its SQL twin."""
