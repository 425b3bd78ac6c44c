"""Sources and sinks: source trees, documents, manifests, version control, bundles."""
