"""An extension: documents that arrive as a stream."""
