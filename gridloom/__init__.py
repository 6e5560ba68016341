"""gridloom: gridded binary weather fields as Spark tables."""
