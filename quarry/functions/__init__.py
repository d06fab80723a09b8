"""Column functions and the HTML tree."""
