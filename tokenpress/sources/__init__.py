"""Sources and sinks: word lists, treebanks, source trees, manifests, conversation and side stores, Markdown bundles."""
