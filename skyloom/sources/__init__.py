"""Catalogues, the archive query dialect, feeds, light-curve readers, named lists and sinks."""
