"""Where results go: manifests, label trees, prediction tables."""
