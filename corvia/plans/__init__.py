"""The rule catalog and the registered queries."""
