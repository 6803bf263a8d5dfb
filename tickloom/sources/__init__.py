"""Reading ticks, raw records and allow-lists."""
