"""Column expressions, without any state fitted from data."""
