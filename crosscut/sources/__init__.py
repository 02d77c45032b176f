"""Reading change sets, snapshots, configuration and events, and writing reports."""
