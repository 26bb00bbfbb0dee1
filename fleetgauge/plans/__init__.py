"""Named jobs: every operator bound to the driver tables, with its SQL check."""
