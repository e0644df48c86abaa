"""The versioned store and the incremental sync that feeds it."""
