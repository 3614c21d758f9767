"""Sources: tables of a store, directories of source files, git repositories."""
