"""Column functions: markup, dates and amounts in free text, quotations."""
