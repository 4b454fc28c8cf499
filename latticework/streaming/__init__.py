"""Nothing here: the library's work is batch work over stored layers, and no streaming operator is claimed."""
