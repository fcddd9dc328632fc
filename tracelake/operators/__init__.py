"""DataFrame operators over the ``events`` table and over the rules' dictionaries. All are lazy."""
