"""Column functions: text, links, markup and strain measures."""
