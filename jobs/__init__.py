"""Runnable jobs: a function that takes a session, a command line that makes one, and a config file beside each."""
