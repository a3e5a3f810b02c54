"""Planning of reads over document columns, before Catalyst sees them."""
