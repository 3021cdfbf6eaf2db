"""Writers; every writer refuses to overwrite unless told otherwise."""
