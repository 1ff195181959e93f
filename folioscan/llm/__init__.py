"""Training-data operators: each module holds one of them; nothing outside imports this package."""
