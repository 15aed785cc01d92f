"""DataFrame-to-DataFrame operators; group keys are passed as a list of column names and hold no NULL."""
