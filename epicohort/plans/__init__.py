"""Stage compositions of the study and the registered query set."""
