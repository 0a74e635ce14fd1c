"""Records that arrive one by one or as a stream."""
