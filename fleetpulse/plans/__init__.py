"""Named health queries and fleet reports, built from the operators."""
