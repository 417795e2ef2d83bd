"""Reading and writing: order messages, warehouse tables, models, test views."""
