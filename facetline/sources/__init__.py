"""Sources and sinks: image folders, decoding, the descriptor index."""
