"""Pure ``Column -> Column`` building blocks (no joins, no shuffles)."""
