"""Column functions: text, inline markup, line splitting."""
