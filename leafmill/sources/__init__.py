"""Sources and sinks: files, images, page sets, and documents as HTML, CSV, JSON, hOCR and zip."""
