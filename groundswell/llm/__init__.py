"""Training-data operators over document tables (see the README's table)."""
