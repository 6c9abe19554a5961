"""Runnable jobs over the library: each a function of a session, with a command line and a config file."""
