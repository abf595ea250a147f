"""Views over tables, and the registered queries."""
