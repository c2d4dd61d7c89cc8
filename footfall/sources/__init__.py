"""Tables and streams that page hits come from and go to."""
