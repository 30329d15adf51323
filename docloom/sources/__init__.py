"""Tables read and written: catalogue, files, registry, stores."""
