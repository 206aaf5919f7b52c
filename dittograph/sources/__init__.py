"""Sources and sinks: file trees, images, settings, reports."""
