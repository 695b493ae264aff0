"""Series operators as DataFrame plans."""
