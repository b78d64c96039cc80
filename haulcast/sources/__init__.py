"""Reading tables, writing predictions, and the shipments view."""
