"""Training-data operators (documents, pages, benchmark): imported by nothing else in the library."""
