"""Beyond the batch scan: files that arrive in a folder, read once each."""
