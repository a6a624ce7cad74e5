"""DataFrame-to-DataFrame operators, independent of any one dataset."""
