"""DataFrame operators: grids, signals, designs, moments, fits."""
