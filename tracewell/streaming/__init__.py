"""Stage events and usage as streams: the batch folds of runs, kept up to date."""
