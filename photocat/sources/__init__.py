"""Where rows come from and where snapshots go."""
