"""Where documents come from: directory trees, archives, file formats."""
