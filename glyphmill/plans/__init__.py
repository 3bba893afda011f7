"""Pattern language and the builtin catalogs: which pointers and command arguments hold text."""
