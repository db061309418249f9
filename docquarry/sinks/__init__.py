"""Writers for CSV, Markdown and text reports."""
