"""Reading session logs, keeping the tables up to date, exporting them."""
