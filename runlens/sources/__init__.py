"""Where tables come from: adapters over local tables, and deliveries."""
