"""Sources: landed responses and pages, tables, seed lists."""
