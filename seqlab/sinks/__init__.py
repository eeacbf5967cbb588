"""Writers in the reference's text formats, metrics and LibSVM."""
