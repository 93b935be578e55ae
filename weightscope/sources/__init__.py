"""Sources: directory walks, container readers, text files."""
