"""Plan-level helpers and composite answers."""
