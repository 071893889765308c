"""Sources: file scans, fetched web pages, routing, document assembly and the document registry."""
