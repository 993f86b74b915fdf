"""DataFrame-to-DataFrame analyses."""
