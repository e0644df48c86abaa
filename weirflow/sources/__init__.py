"""Where changes come from: snapshots, high-water marks, change logs, messages."""
